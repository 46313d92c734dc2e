"""Small cases and brute-force versions of the ten operators."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"
SMALL = "/root/testdata/sf0.001"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], DOCS)


def odd_rows():
    """Nulls in every column, empty and blank texts, repeated ids and rows, ties, a long text."""
    long = " ".join(f"w{n % 977}" for n in range(30_000))
    return [(1, "a b c d", "s"), (1, "a b c d", "s"), (2, None, "s"), (3, "", None), (4, " \t\n ", "s"), (None, "x y z", "t"), (5, long, "t"), (5, "other text", None), (6, "é 日本 \x01 .", "u")]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame([(i, t, None if s is None else "en", s, 7, 1.5) for i, t, s in odd_rows()], DOCS + ", node int, score double")
    return docs


def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


# --- text helpers ---------------------------------------------------------


def test_words_and_hashes():
    import pyarrow as pa

    from siteledger.llm.textops import span_hashes, spans, texts

    col = pa.array(["ab Cd", None, "ab", "", " x\ty ", "cd"])
    for step in (1, 4, 10_000):
        got = []
        for t in texts(col, step):
            s, e, o = spans(t)
            got += [(t.first + k, bytes(t.data[i:j]).decode(), h) for i, j, k, h in zip(s, e, o, span_hashes(t, s, e, True))]
        assert [(k, w) for k, w, _ in got] == [(0, "ab"), (0, "Cd"), (2, "ab"), (4, "x"), (4, "y"), (5, "cd")]
        assert got[0][2] == got[2][2] and got[1][2] == got[5][2] and len({h for *_, h in got}) == 4


def test_ranked_is_gapless(spark):
    from siteledger.llm.common import ranked

    df = spark.createDataFrame([(n % 3 if n % 7 else None, n) for n in range(100)], "k int, v int")
    by = {}
    for r in ranked(df, ["k"], ["v"], "n", parts=5).collect():
        by.setdefault(r.k, []).append(r.n)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and len(by) == 4
    assert sorted(r.n for r in ranked(df, [], ["v"], "n").collect()) == list(range(100))


def test_components(spark):
    from siteledger.llm.components import components

    rng = random.Random(3)
    links = [(n, n + 1) for n in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[find(a)] = find(b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    want = {n: find(n) for n in got}
    assert len(set(zip(got.values(), want.values()))) == len(set(got.values())) == len(set(want.values()))


# --- 1: n-gram Jaccard join -----------------------------------------------


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, width, percent):
    from siteledger.llm.ngram_join import near_duplicates

    rng = random.Random(width)
    base = [[f"v{rng.randrange(400)}" for _ in range(60)] for _ in range(12)]
    texts = {}
    for n in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"V{rng.randrange(50)}"
        texts[n] = " ".join(w)
    texts |= {200: "", 201: None, 202: "one", 203: "ONE", 204: "one two", 205: " ", 206: "one  two"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(rows, width, percent).collect()}
    assert got == brute_components(texts, width, percent)


@pytest.mark.parametrize("size", [None, 16])
def test_join_counts_every_link(spark, size, monkeypatch):
    """Groups of near copies, also in several blocks: links of each document, equal sets included."""
    from siteledger.llm import ngram_join

    if size:
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", size)
        monkeypatch.setattr(ngram_join, "DENSE_PAIRS", size)
    rng = random.Random(11)
    base = [[f"v{rng.randrange(400)}" for _ in range(60)] for _ in range(3)]
    texts = {n: list(base[min(n // 60, 2)]) for n in range(150)}
    for n, w in texts.items():
        for _ in range(n % 3):
            w[rng.randrange(60)] = f"x{rng.randrange(50)}"
    texts = {n: " ".join(w) for n, w in texts.items()} | {200: "", 201: "one", 202: "ONE", 203: "two"}
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w)} if 0 < len(w) < 3 else {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    want = {a: sum(a != b and bool(x & y) and 100 * len(x & y) >= 80 * len(x | y) for b, y in sets.items()) for a, x in sets.items()}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(rows, 3, 80).collect()}
    assert got == want and 0 < sum(want.values()) < 150 * 149


@pytest.mark.parametrize("pairs", [0, 40, 10**6])
def test_overlaps(pairs, monkeypatch):
    from siteledger.llm import ngram_join

    monkeypatch.setattr(ngram_join, "DENSE_PAIRS", pairs)
    monkeypatch.setattr(ngram_join, "DENSE_COLUMNS", 7)
    rng = np.random.default_rng(4)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(0, 40)) ** 2) for _ in range(n)] for n in (9, 14))
    assert ngram_join.overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert ngram_join.overlaps(a, []).shape == (9, 0)


def test_join_of_odd_rows(spark, odd):
    from siteledger.llm.ngram_join import deduplicated, near_duplicates

    got = near_duplicates(odd, 3, 90).collect()
    assert len(got) == len(odd_rows())
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (None, None), (5, 5), (6, 6)}
    kept = deduplicated(odd, 3, 90)
    assert kept.columns == odd.columns and near_duplicates(empty(spark), 3, 90).count() == 0 and deduplicated(empty(spark), 3, 90).count() == 0


def test_deduplicated_keeps_one_of_a_group(spark):
    from siteledger.llm.ngram_join import deduplicated

    words = [f"w{n}" for n in range(100)]
    rows = [(9, " ".join(words), "s"), (3, " ".join(words[:-1]), "s"), (5, " ".join(words), "t"), (7, "quite another text of several words", "s")]
    assert sorted(r.doc_id for r in deduplicated(frame(spark, rows), 5, 80).collect()) == [3, 7]


def test_sizes_of_more_short_texts_than_places(spark):
    """70,000 short texts after a flush by bytes in the middle of a batch: no place overflows."""
    from siteledger.llm.ngram_join import set_sizes

    # 3,000 long texts of common words, then short ones, all in one partition.
    long = F.concat_ws(" ", F.lit("common " * 714), F.col("id"))
    text = F.when(F.col("id") < 3000, long).when(F.col("id") % 3 == 0, F.concat(F.lit("t"), F.floor(F.col("id") / 6))).otherwise(F.concat(F.lit("t"), F.col("id") + 10**6))
    rows = spark.range(0, 80_000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    alone = [{r.doc_id: r.alone for r in set_sizes(x, 1).filter("alone > 0").collect()} for x in (rows, rows.repartition(8))]
    assert alone[0] == alone[1] and len(alone[0]) > 10_000


def test_deduplicated_goes_by_component_not_by_id(spark, odd):
    """Repeated and null ids: unlinked texts stay, repeated rows and near copies go."""
    from siteledger.llm.ngram_join import deduplicated

    words = [f"w{n}" for n in range(100)]
    full, near = " ".join(words), " ".join(words[:-1])
    rows = [(None, "one text of its own", "s"), (None, "and quite another one here", "s"), (None, None, "s"), (8, full, "s"), (3, near, "s"), (None, full + " z", "s")]
    rows += [(3, "has the id of a linked row", "s"), (5, "said twice by one id", "s"), (5, "said twice by one id", "t"), (5, "something else by it", "s")]
    got = Counter((r.doc_id, r.text) for r in deduplicated(frame(spark, rows), 5, 80).collect())
    assert got == Counter({(i, t) for i, t, _ in rows} - {(8, full), (None, full + " z")})
    got = Counter((r.doc_id, r.text) for r in deduplicated(odd, 3, 90).collect())
    assert got == Counter({(i, t) for i, t, _ in odd_rows()})


# --- 2: sharding ----------------------------------------------------------


def test_sharding(spark, small):
    from siteledger.llm.sharding import op2_sharding

    got = op2_sharding(spark, small).collect()
    texts = texts_of(spark, small)
    assert len(got) == len(texts)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    by = {}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        by.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) - 1 for s in by.values()) <= 1


def test_sharding_splits_a_group_that_is_too_big(spark):
    from siteledger.llm.common import stored
    from siteledger.llm.sharding import shard_rows

    rows = spark.range(1000).select(F.col("id").alias("row"), F.when(F.col("id") < 400, F.lit(1)).otherwise(F.col("id") + 10).alias("hub"))
    got = shard_rows(stored(rows), 8).collect()
    assert Counter(Counter(r.shard for r in got).values()) == {125: 8}
    hot = Counter(r.shard for r in got if r.hub == 1)
    assert len(hot) == 4 and sorted(hot.values()) == [25, 125, 125, 125]
    assert shard_rows(stored(rows.filter("false")), 8).count() == 0


def test_sharding_exchanges_rows_of_full_shards(spark):
    """Every row has an equal one, so that no shard ever has room."""
    from siteledger.llm.common import stored
    from siteledger.llm.sharding import shard_rows

    rows = spark.range(800).select(F.col("id").alias("row"), F.floor(F.col("id") / 2).alias("hub"))
    got = shard_rows(stored(rows), 8).collect()
    assert Counter(Counter(r.shard for r in got).values()) == {100: 8}
    by = {}
    for r in got:
        by.setdefault(r.hub, set()).add(r.shard)
    assert sum(len(s) == 1 for s in by.values()) > 0.8 * len(by)


@pytest.mark.parametrize("n, size, linked", [(4800, 5, 1.0), (6000, 3, 1.0), (4800, 5, 0.95), (2400, 2, 1.0)])
def test_sharding_cuts_a_group_a_border(spark, n, size, linked):
    """All or nearly all rows are linked, so rounds end with many split groups."""
    from siteledger.llm.common import stored
    from siteledger.llm.sharding import SHARDS, shard_rows

    hub = F.when(F.col("id") < int(n * linked), F.floor(F.col("id") / size)).otherwise(F.col("id") + n)
    got = shard_rows(stored(spark.range(n).select(F.col("id").alias("row"), hub.alias("hub")))).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == n and set(sizes) == set(range(SHARDS)) and max(sizes.values()) - min(sizes.values()) <= 1
    by = {}
    for r in got:
        by.setdefault(r.hub, set()).add(r.shard)
    assert sum(len(s) - 1 for s in by.values()) < SHARDS


def test_sharding_gathers_beside_a_hot_group(spark):
    """A third of all rows in one group, the others in groups of four."""
    from siteledger.llm.common import stored
    from siteledger.llm.sharding import shard_rows

    hub = F.when(F.col("id") < 600, F.lit(-1)).otherwise(F.floor(F.col("id") / 4))
    got = shard_rows(stored(spark.range(1800).select(F.col("id").alias("row"), hub.alias("hub"))), 8).collect()
    assert Counter(Counter(r.shard for r in got).values()) == {225: 8}
    by = {}
    for r in got:
        by.setdefault(r.hub, set()).add(r.shard)
    assert sum(len(s) - 1 for s in by.values()) <= 7


def test_granted_moves_fit():
    from siteledger.llm.sharding import _granted

    assert _granted({(0, 1): 5, (1, 0): 3}, [0, 0]) == {(0, 1): 3, (1, 0): 3}
    assert _granted({(0, 1): 5, (1, 2): 4, (2, 0): 9}, [0, 0, 1]) == {(0, 1): 4, (1, 2): 4, (2, 0): 4}
    assert _granted({(0, 1): 5}, [0, 2]) == {(0, 1): 2}


# --- 3: exact top-k search ------------------------------------------------


def test_search_equals_brute_force(spark, small):
    from siteledger.llm import wand_search

    texts = texts_of(spark, small)
    tf = {i: Counter(WORD.findall(lower(t))) for i, t in texts.items()}
    df = Counter(w for c in tf.values() for w in c)
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    queries = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = {}
    for r in wand_search.top_k(docs, queries, 5, "lang").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    for q in range(0, len(texts), 20):
        scores = {}
        for d, c in tf.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in tf[q] if w in c)
            if s:
                scores[d] = round(s, 6)
        best = sorted(scores, key=lambda d: (-scores[d], d))[:5]
        mine = sorted(got.get(q, []))
        assert [d for _, d, _ in mine] == best and all(abs(s - scores[d]) < 2e-6 for _, d, s in mine)


def test_search_prunes_and_stays_exact():
    """Topics of frequent and rare terms, a window and a half each, and documents as queries."""
    from siteledger.llm.wand_search import BLOCK, WINDOW, Shard

    rng = np.random.default_rng(5)
    blocks, n_terms = 6 * WINDOW, 2400
    n, docs, starts = blocks * BLOCK, [], [0]
    for t in range(n_terms):
        low, wide = (n // 4 * (t % 4), n // 4) if t > 40 else (0, n)
        docs.append(np.unique(low + rng.integers(0, wide, max(2, int(0.3 * wide / (t // 4 + 1) ** 0.8 if t <= 40 else wide / (t // 4) ** 0.8)))))
        starts.append(starts[-1] + len(docs[-1]))
    of_term, doc = np.repeat(np.arange(n_terms), np.diff(starts)), np.concatenate(docs)
    idf = np.log1p((n - np.diff(starts) + 0.5) / (np.diff(starts) + 0.5))
    row = {"n_docs": n, "ids": np.arange(n, dtype=np.int64).tobytes(), "known": np.ones(n, bool).tobytes(), "lengths": np.full(n, 50, "<i8").tobytes(), "terms": np.arange(n_terms, dtype=np.uint64).tobytes(), "starts": np.array(starts, "<u4").tobytes(), "postings": doc.astype("<u2").tobytes(), "counts": rng.integers(1, 4, len(doc)).astype("<u4").tobytes()}
    shard = Shard(row, 50.0, np.arange(n_terms + 9, dtype=np.uint64), np.append(idf, np.ones(9)))
    every = 0
    for q in rng.integers(0, n, 12):
        q = np.append(np.unique(of_term[doc == q]), n_terms + 5).astype(np.uint64)
        mine = np.isin(of_term, q)
        full = np.round(np.bincount(doc[mine], weights=shard.impact[mine], minlength=n), 6)
        best, scores = shard.search(q, 10)
        want = np.lexsort((np.arange(n), -full))[:10]
        assert np.allclose(scores, full[want]) and list(best) == list(want)
        every += mine.sum()
        spent = shard.scored
        assert list(shard.search(q, 10, scores[-1])[0]) == list(best)
        assert len(shard.search(q, 10, scores[0] + 1)[0]) == 0
        shard.scored = spent
    assert shard.scored < 0.8 * every, (shard.scored, every)


def test_search_of_odd_rows(spark, odd):
    from siteledger.llm.wand_search import top_k

    q = odd.select(F.col("doc_id").alias("query_id"), "text")
    got = top_k(odd, q).collect()
    assert {r.query_id for r in got} == {1, None, 5, 6} and all(r.score > 0 for r in got)
    assert top_k(empty(spark), empty(spark).select(F.col("doc_id").alias("query_id"), "text")).count() == 0


def _corpus(rng, n, topics=4, words=900):
    """Texts of topics that share frequent words; lengths vary, some texts are copies."""
    weight = 1 / np.arange(2, words + 2)
    out = []
    for i in range(n):
        t = int(rng.integers(topics))
        w = rng.choice(words, int(rng.integers(3, 160)), p=weight / weight.sum())
        out.append((i, " ".join(f"{'all' if x < 12 else t}.{x}" for x in w) if i % 9 or not out else out[-1][1], t if i % 9 or not out else out[-1][2]))
    return out


def _best(rows, asked, k):
    """The k best (score, id) of each text that is asked for, by brute force."""
    tf = {i: Counter(t.split()) for i, t, _ in rows}
    df = Counter(w for c in tf.values() for w in c)
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    size = {d: sum(c.values()) for d, c in tf.items()}
    out = {}
    for q in asked:
        found = [(-round(s, 6), d) for d, c in tf.items() if (s := sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[d] / mean)) for w in tf[q] if w in c))]
        out[q] = [(d, -s) for s, d in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("parts", [1, 40])
def test_search_of_many_queries_equals_brute_force(spark, parts):
    """Queries in groups, over one shard and over many of which some are searched first."""
    from siteledger.llm.wand_search import FEW, build_index, top_k

    rows = _corpus(np.random.default_rng(8), 900)
    docs = spark.createDataFrame(rows, "doc_id long, text string, topic int").repartition(parts, "doc_id")
    shards = build_index(docs, "topic").groupBy("pick").count().collect()
    assert parts == 1 or len({r.pick for r in shards if r["count"]}) > 1 and any(r.pick == 0 for r in shards)
    queries = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), "text", "topic")
    want = _best(rows, range(0, 900, 3), 7)
    assert len(want) > FEW
    for q in (queries, queries.drop("topic")):
        got = {}
        for r in top_k(docs, q, 7, "topic").collect():
            got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
        for i, best in want.items():
            mine = sorted(got[i])
            assert [d for _, d, _ in mine] == [d for d, _ in best] and all(abs(a - b) < 2e-6 for (_, _, a), (_, b) in zip(mine, best))


def test_search_reads_shared_terms_once(spark):
    """Queries in groups read few postings one by one; one by one they read nearly all."""
    import pyarrow as pa

    from siteledger.llm.wand_search import Best, Grouped, Queries, Shard, build_index

    rows = _corpus(np.random.default_rng(9), 1500)
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string, topic int").coalesce(1), "topic").collect()
    assert len(index) == 1
    row = index[0].asDict()
    terms, starts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["starts"], "<u4").astype(int)
    doc, topic = np.frombuffer(row["postings"], "<u2"), {i: t for i, _, t in rows}
    ids, of = np.frombuffer(row["ids"], np.int64), np.repeat(np.arange(len(terms)), np.diff(starts))
    asked = [np.flatnonzero(np.bincount(of[doc == d], minlength=len(terms))) for d in range(0, 1500, 5)]
    weight = np.log1p((1500 - np.diff(starts) + 0.5) / (np.diff(starts) + 0.5))
    table = pa.table({"row": np.arange(len(asked)), "near": [topic[int(ids[d])] for d in range(0, 1500, 5)], "terms": [terms[a].view(np.int64).tolist() for a in asked], "idf": [weight[a].tolist() for a in asked]})
    queries = Queries(table)
    mean = row["n_words"] / 1500
    one, many, best = Shard(row, mean, queries.asked, queries.weights), Grouped(row, mean, queries), Best(np.zeros(len(queries)), 10)
    q, docs, scores = many.search(10, best)
    for i in range(len(queries)):
        want, to = one.search(queries.asked[queries.terms[queries.starts[i] : queries.starts[i + 1]]], 10)
        mine = np.flatnonzero(q == i)
        mine = mine[np.lexsort((many.ids[docs[mine]], -scores[mine]))][:10]
        assert list(docs[mine]) == list(want) and np.allclose(scores[mine], to)
        assert best.floor(i) == (min(to) if len(to) == 10 else 0)
    assert many.scored < one.scored / 4, (many.scored, one.scored)
    # From these thresholds on the same rows come out, and from higher ones none.
    again = Grouped(row, mean, queries).search(10, Best(best.scores[:, 0].copy(), 10))
    assert set(zip(*again[:2])) >= {(a, b) for a, b, s in zip(q, docs, scores) if s > best.floor(a)}
    assert not len(Grouped(row, mean, queries).search(10, Best(np.full(len(queries), 1e6), 10))[0])


def test_many_odd_queries(spark, odd):
    """Null ids, null and empty texts, repeated ids: in groups as one by one."""
    from siteledger.llm.wand_search import FEW, top_k

    docs = odd
    q = odd.select(F.col("doc_id").alias("query_id"), "text")
    many = q
    for _ in range(FEW):
        many = many.unionAll(q)
    count = lambda x: Counter((r.query_id, r.rank, r.doc_id, r.score) for r in top_k(docs, x).collect())
    one, all_ = count(q), count(many)
    assert {x: n * (FEW + 1) for x, n in one.items()} == dict(all_)


# --- 4: Pitman-Yor --------------------------------------------------------


def test_language_model(spark, small):
    from siteledger.llm.pitman_yor import op4_pitman_yor

    tokens = {i: WORD.findall(lower(t)) + ["\0"] for i, t in texts_of(spark, small).items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in op4_pitman_yor(spark, small).collect()}
    assert set(got) == set(tokens)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_sum_to_one(spark):
    """Texts of one word each: the model's probabilities of all words and of an unknown one after the start."""
    from siteledger.llm.pitman_yor import score_documents

    words = ["a"] * 30 + ["b"] * 12 + ["c"] * 5 + ["d"]
    rows = [(n, False, w) for n, w in enumerate(words)] + [(1000 + n, True, w) for n, w in enumerate(["a", "b", "c", "d", "new", ""])]
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string")).collect()}
    end_after_start = 10 ** got[1005]
    # P(w after start) = P(text w) / P(end after w); ends are all that ever follow a word.
    assert 0 < end_after_start < 0.2 and got[1000] > got[1001] > got[1002] > got[1003] > got[1004]
    assert sum(10 ** got[1000 + k] for k in range(5)) + end_after_start < 1.0 + 1e-9


@pytest.mark.parametrize("n", [10, 200])
def test_scores_against_brute_force(spark, n):
    """Words that occur once each, so that no seating is drawn: with 10 all of them are spread over parts, with 200 none."""
    from siteledger.llm.pitman_yor import score_documents

    words = [f"w{k}" for k in range(n)]
    texts_ = [" ".join(words), " ".join(words[::-1]), "w3 w4", "w4 other w3", "w9", None]
    rows = spark.createDataFrame([(k, k > 0, t) for k, t in enumerate(texts_)], "doc_id long, held_out boolean, text string")
    tokens = [*words, "\0"]
    d, total, seen = 0.95, len(tokens), set(zip(["\1", *tokens], tokens))
    contexts = {u for u, _ in seen}

    def p(u, w):
        known = w in tokens
        parent = ((1 - d) * known + (1 + d * total) / (total + 1)) / (1 + total)
        return ((1 - d) * ((u, w) in seen) + (1 + d) * parent) / 2 if u in contexts else parent

    for r in score_documents(rows).collect():
        t = [*WORD.findall(texts_[r.doc_id] or ""), "\0"]
        assert math.isclose(r.score, sum(math.log10(p(u, w)) for u, w in zip(["\1", *t], t)), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10(((w in tokens) + 0.5) / (total + 0.5 * (total + 1))) for w in t), rel_tol=1e-9)


def test_language_model_of_odd_rows(spark, odd):
    from siteledger.llm.pitman_yor import score_documents

    got = score_documents(odd.withColumn("held_out", F.col("doc_id") == 6)).collect()
    assert len(got) == len(odd_rows()) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert score_documents(empty(spark).withColumn("held_out", F.lit(False))).count() == 0
    assert all(math.isfinite(r.score) for r in score_documents(odd.withColumn("held_out", F.lit(True))).collect())


def test_seating_follows_its_distribution():
    from siteledger.llm.pitman_yor import sample_tables

    rng = np.random.default_rng(1)
    t = sample_tables(np.full(20_000, 3), np.full(20_000, 0.7), 0.4, rng)
    # Weights of t tables for 3 customers: generalised Stirling numbers times 0.7 ** t.
    s = np.array([0.6 * 1.6, 3 * 0.6, 1.0]) * 0.7 ** np.arange(1, 4)
    assert np.allclose(np.bincount(t, minlength=4)[1:] / 20_000, s / s.sum(), atol=0.015)
    many = sample_tables(np.array([1, 0, *[5000] * 20_000]), np.ones(20_002), 0.5, rng)
    # Of very many customers, all tables but one follow nearly a Poisson law of mean pull / discount.
    assert many[0] == 1 and many[1] == 0 and many[2:].min() == 1
    assert abs(many[2:].mean() - 3) < 0.06 and abs(many[2:].std() - math.sqrt(2)) < 0.06


def test_many_customers_are_seated_as_the_exact_conditional_says():
    """Tables of up to 1000 customers: means and deviations against the conditional
    itself, which is pull ** tables times a generalised Stirling number."""
    from siteledger.llm.pitman_yor import sample_tables

    def conditional(c, pull, d):
        logs = np.full(c + 2, -np.inf)
        logs[1] = 0.0
        for m in range(1, c):
            new = np.full(c + 2, -np.inf)
            new[1:] = np.logaddexp(logs[:-1], logs[1:] + np.log(np.maximum(m - d * np.arange(1, c + 2), 1e-300)))
            new[m + 2 :] = -np.inf
            logs = new
        w = logs[1 : c + 1] + np.arange(1, c + 1) * math.log(pull)
        w = np.exp(w - w.max())
        return w / w.sum()

    rng, n = np.random.default_rng(3), 6000
    for d in (0.3, 0.75):
        for c in (5, 64, 65, 128, 1000):
            for pull, within in ((0.05, 0.03), (1.0, 0.04), (20.0, 0.08)):
                p = conditional(c, pull, d)
                tables = np.arange(1, c + 1)
                mean = (p * tables).sum()
                sd = math.sqrt((p * tables**2).sum() - mean**2)
                got = sample_tables(np.full(n, c), np.full(n, pull), d, rng)
                slack = 4 * sd / math.sqrt(n)
                assert abs(got.mean() - mean) < (within * mean if c > 64 else 0) + slack, (d, c, pull)
                assert abs(got.std() - sd) < 0.12 * sd + 0.02 and got.min() >= 1 and got.max() <= c


# --- 5: sorted shards -----------------------------------------------------


def test_sorted_shards(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    from siteledger.llm.sorted_shards import op5_sorted_shards

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = {}, 0
    for i, x in sorted(texts_of(spark, small).items()):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op5_sorted_shards(spark, small).collect()} == want


def test_shard_lookup(tmp_path):
    from pyarrow import fs

    from siteledger.llm.sorted_shards import ShardReader, ShardWriter, id_of, key_of

    path, rng = str(tmp_path / "x.sst"), random.Random(2)
    ids = sorted(rng.sample(range(-(10**9), 10**9), 3000))
    local = fs.LocalFileSystem()
    with local.open_output_stream(path) as out:
        w = ShardWriter(out, 2)
        w.add(key_of(None), b"no")
        for i in ids:
            w.add(key_of(i), bytes(f"{i:>60}"[:60], "ascii"))
            if i == ids[77]:
                w.add(key_of(i, 1), b"second")
        w.close()
    with local.open_input_file(path) as f:
        r = ShardReader(f)
        assert r.n_blocks > 1 and r.n_docs == 3002
        assert [id_of(k) for k, _ in r.scan()][:2] == [None, ids[0]]
        for i in rng.sample(ids, 50):
            assert r.find(i)[0] == bytes(f"{i:>60}"[:60], "ascii")
        assert len(r.find(ids[77])) == 2 and r.find(None) == [b"no"]
        missing = [x for x in range(2000) if x not in set(ids)]
        assert all(r.find(x) == [] for x in missing[:200]) and sum(r.might_hold(x) for x in missing) < 0.05 * len(missing)
    raw = bytearray(open(path, "rb").read())
    raw[100] ^= 1
    open(path, "wb").write(bytes(raw))
    with local.open_input_file(path) as f, pytest.raises(ValueError, match="damaged"):
        list(ShardReader(f).scan())


def test_shards_of_odd_rows(spark, odd, tmp_path):
    import public_tokenizers

    from siteledger.llm.sorted_shards import read_shards, write_shards

    got = read_shards(write_shards(odd, public_tokenizers.path("byte_bpe_50k.json"), 0, f"file://{tmp_path}/s")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 5, 6] and [r.n_tokens for r in got if r.doc_id in (2, 3)] == [1, 1]
    assert read_shards(write_shards(empty(spark), public_tokenizers.path("byte_bpe_50k.json"), 0, f"file://{tmp_path}/e")).count() == 0


def test_encoder_equals_the_library():
    """The plain library, special tokens and all; also on texts of odd characters."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from siteledger.llm.tokens import encoder

    texts = ["", " ", "a", "a  b", " lead", "tail ", "a\n\n b\n", "x \n y", "\tq\t\tr", "it's I'll don't", "Éa ÀÇß é ŉ İ", "日本語 ΑΣ Σ", "ab\x1c cd", "a\x01b c", "1234 5,6.7", "Hello, World! (x)", "<|endoftext|> x", "a b", "word.\nNext"]
    texts += ["Hİ!", "KADIKÖYDEKİ. x", "क़, क़", "a<|endoftext|>.b <|ENDOFTEXT|>", "x<|startoftext|>!", "don't<|endoftext|>'s"]
    rng = random.Random(5)
    letters = [*"abAB zZ éÉßİıŉǅΣσς日本क़ख़ \u0338\u0307\u0301.,;:!?'<|>#*$%&_-19²Ⅷ\n\t\r\x0b\x1c\x01\x85\xa0\u2028\u3000", "<|endoftext|>", "<|startoftext|>", "'LL", " ", "  ", "\n\n", " \n", "e\u0301"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    for name, code, drops in (("byte_bpe_50k.json", "H", False), ("word_bpe_49k.json", "I", True)):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        e = encoder(public_tokenizers.path(name), code, drops)
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        for _ in range(2):
            assert [np.frombuffer(b, f"<u{2 if code == 'H' else 4}").tolist() for b in e.encode(texts)] == want


# --- 6: packing -----------------------------------------------------------


def plain_best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        room = [r for r in bins if r >= n]
        if room:
            bins.remove(min(room))
            bins.append(min(room) - n)
        else:
            bins.append(size - n)
    return sorted(bins)


def test_plan_equals_best_fit_decreasing():
    from siteledger.llm.packing import plan

    rng = random.Random(4)
    for size in (10, 64, 100):
        for _ in range(40):
            lengths = [rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 120))]
            used = Counter()
            for length, lo, hi, first, each, at in plan(Counter(lengths), size):
                for k in range(hi - lo):
                    assert used[first + k // each] == at + k % each * length
                    used[first + k // each] += length
            assert sorted(size - u for u in used.values()) == plain_best_fit(lengths, size)


def test_capacity_tree():
    from siteledger.llm.packing import CapacityTree

    rng, t, have = random.Random(1), CapacityTree(100), set()
    for _ in range(500):
        c, on = rng.randrange(101), rng.random() < 0.4
        t.set(c, on)
        have = have | {c} if on else have - {c}
        need = rng.randrange(101)
        assert t.tightest(need) == min((x for x in have if x >= need), default=None)


def test_packing(spark, small, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    from siteledger.llm.packing import op6_packing, pack_documents

    name = public_tokenizers.path("word_bpe_49k.json")
    got = op6_packing(spark, small).collect()
    t, want = Tokenizer.from_file(name), {}
    for i, x in texts_of(spark, small).items():
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            cut = np.array(ids[at : at + 4096], "<u4")
            want[i, at // 4096] = (at, len(cut), zlib.crc32(cut.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in by.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= 1.02 * sum(r.length for r in got) / 4096 + 1
    pieces = pack_documents(odd, name, 1).collect()
    assert len(pieces) >= len(odd_rows()) and sum(r.length for r in pieces if r.doc_id in (2, 3, 4)) == 3
    assert pack_documents(empty(spark), name, 1).count() == 0


# --- 7: toxicity ----------------------------------------------------------


def toxic_world(spark, n=600):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdf')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.randrange(30)}" for _ in range(40)]
        bad = rng.random() < 0.3
        if bad:
            words[rng.randrange(40)] = rng.choice(["grumbleface", "grumblenose"])
        rows.append((i, " ".join(words[:20]) + ". " + " ".join(words[20:]) + ".", "s"))
        labels.append((i, int(bad)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_learns_from_document_labels(spark, odd):
    from siteledger.llm.toxicity import drop_toxic, fit_on, held_out, with_score

    docs, labels, truth = toxic_world(spark)
    model = fit_on(docs, labels)
    got = with_score(docs, model, ["doc_id"], locate=True).withColumn("out", held_out()).collect()
    out = [r for r in got if r.out]
    assert len(out) > 60 and sum((r.score >= 0.5) == truth[r.doc_id] for r in out) >= 0.95 * len(out)
    texts = {r.doc_id: r.text for r in docs.collect()}
    hits = [(texts[r.doc_id].encode()[s.start : s.end].decode()) for r in got for s in r.offending]
    assert hits and sum("grumble" in h for h in hits) >= 0.95 * len(hits)
    kept = drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows())
    scores = {r.doc_id: r.score for r in with_score(odd, model, ["doc_id"]).collect()}
    assert scores[2] == scores[3] == 0.0
    assert fit_on(docs, labels.filter("toxic = 0")).bias == -40.0 and drop_toxic(empty(spark), labels).count() == 0


# --- 8: mixing ------------------------------------------------------------


def shares(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while True:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]] if total else []
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)
        left = sum(sizes.values()) - sum(target.values())


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10, "d": 500}, {"a": 1, "b": 1, "c": 900, None: 40}, {"z": 7}, {"é": 50, "zz": 50, "Z": 50, "a": 0}])
def test_targets(spark, sizes):
    from siteledger.llm.mixing import source_targets

    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = shares(sizes)
    assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in sizes)


def test_taken_words_equal_a_walk_over_each_source(spark, small):
    """All words of a source once a whole epoch, then those of the order's first
    documents until the target is met."""
    from siteledger.llm.mixing import SEED, mix, op8_mixing, sized

    rows = sized(spark.read.parquet(f"{small}/documents.parquet"))
    keyed = rows.withColumn("key", F.xxhash64(F.lit(SEED), "doc_id", "__tie")).collect()
    got = {r.doc_id: r for r in op8_mixing(spark, small).collect()}
    by = {}
    for r in keyed:
        by.setdefault(r.source, []).append(r)
    for docs in by.values():
        total = sum(r["size"] for r in docs)
        full, rest = divmod(round(got[docs[0].doc_id].target), total)
        for r in sorted(docs, key=lambda r: (r.key >> 40 if r.key >= 0 else (r.key + 2**64) >> 40, r.key, r["__row"])):
            last = min(max(rest, 0), r["size"])
            rest -= r["size"]
            assert got[r.doc_id].taken == full * r["size"] + last
    draws, _ = mix(rows)
    assert draws.groupBy("doc_id").agg(F.sum("words").alias("w")).filter("w > 0").count() == sum(r.taken > 0 for r in got.values())


def test_mixing(spark, small):
    from siteledger.llm.mixing import op8_mixing

    texts = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op8_mixing(spark, small).collect()}
    assert {r.doc_id: r.taken for r in op8_mixing(spark, small).collect()} == {i: r.taken for i, r in got.items()}
    sizes, taken = Counter(), Counter()
    for i, (t, s) in texts.items():
        assert got[i].size == len(WORD.findall(t)) and 0 <= got[i].taken <= 3 * got[i].size
        sizes[s] += got[i].size
        taken[s] += got[i].taken
    want = shares(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 and math.isclose(got[i].target, want[s], abs_tol=1e-6) for i, (_, s) in texts.items())


def test_splitting_tree_is_exact_and_fair(spark):
    from siteledger.llm.mixing import hypergeometric, split_quotas

    q = spark.createDataFrame([([("a", 1000), ("b", 500), (None, 3), ("z", 0)],)], "quotas array<struct<source: string, q: long>>")
    leaves = [{x.source: x.q for x in r.quotas} for r in split_quotas(q, 10).collect()]
    assert len(leaves) == 10 and Counter({k: sum(x[k] for x in leaves) for k in leaves[0]}) == Counter({"a": 1000, "b": 500, None: 3, "z": 0})
    assert all(abs(sum(x.values()) - 150) <= 1 for x in leaves) and len({x["a"] for x in leaves}) > 3
    draws = spark.range(4000).select(F.expr(hypergeometric("30L", "70L", "20L", "((id + 0.5D) / 4000)")).alias("k"))
    n = Counter(r.k for r in draws.collect())
    for k, c in n.items():
        p = math.comb(30, k) * math.comb(70, 20 - k) / math.comb(100, 20)
        assert abs(c / 4000 - p) < 1e-3


def test_mixing_of_odd_rows(spark, odd):
    from siteledger.llm.mixing import mix, mixed_documents, n_words, sized

    draws, known = mix(sized(odd))
    assert known.count() == len(odd_rows()) and draws.filter("size = 0").count() == 0
    total = known.agg(F.sum("size")).first()[0]
    mixed = mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert abs(mixed.agg(F.sum(n_words(F.col("text")))).first()[0] - total) <= 3
    assert mixed_documents(empty(spark)).count() == 0


def test_repeated_rows_have_draws_of_their_own(spark):
    """Each row twice: the mix meets its target and no row is drawn more than another."""
    from siteledger.llm.mixing import mixed_documents, n_words

    rows = [(i // 2, " ".join(f"w{i // 2}x{k}" for k in range(100)), "s") for i in range(200)]
    got = mixed_documents(frame(spark, rows)).select("doc_id", n_words(F.col("text")).alias("n")).collect()
    assert sum(r.n for r in got) == 20_000 and set(Counter(r.doc_id for r in got).values()) == {2}


def test_the_tree_places_draws_and_leaves_totals(spark, small):
    from siteledger.llm.mixing import mix, sized

    rows = sized(spark.read.parquet(f"{small}/documents.parquet"))
    seen = []
    for shards, seed in ((64, 7), (64, 8), (3, 7)):
        draws = mix(rows, shards, seed)[0].collect()
        assert max(r.shard for r in draws) < shards
        seen.append((sum(r.words for r in draws), sorted((r.doc_id, r.epoch, r.shard) for r in draws)))
    assert seen[0][0] == seen[1][0] == seen[2][0] and seen[0][1] != seen[1][1] != seen[2][1]


# --- 9: preferences -------------------------------------------------------


def plain_pair(c, r):
    show = lambda turns: "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in turns)
    p = 0
    while p < min(len(c), len(r)) and c[p] == r[p]:
        p += 1
    return p, show(c[:p]), show(c[p:]), show(r[p:])


def test_preferences(spark):
    from siteledger.llm.preferences import format_pairs

    pairs = {
        1: ([("user", "q"), ("assistant", "good")], [("user", "q"), ("assistant", "bad")]), 2: ([("system", "s"), ("user", "q"), ("assistant", "a")], [("system", "s"), ("user", "q"), ("assistant", "a")]),
        3: ([("user", "q"), ("assistant", "a"), ("user", "more"), ("assistant", "é")], [("user", "q")]), 4: ([("user", "x")], [("user", "y"), ("assistant", "z")]), 5: ([("user", "q"), ("assistant", "a")], []),
    }
    sides = [[(p, n, role, text) for p, both in pairs.items() for n, (role, text) in enumerate(both[k])] for k in (0, 1)]
    schema = "pair_id long, turn int, role string, text string"
    got = {r.pair_id: r for r in format_pairs(*[spark.createDataFrame(s, schema) for s in sides]).collect()}
    for p, (c, r) in pairs.items():
        assert (got[p].n_prompt_turns, got[p].prompt, got[p].chosen, got[p].rejected) == plain_pair(c, r)
        for text, spans in ((got[p].chosen, got[p].chosen_spans), (got[p].rejected, got[p].rejected_spans)):
            assert [text[s.start : s.end] for s in spans] == [x + "<|end|>" for x in re.findall(r"<\|assistant\|>\n(.*?)<\|end\|>", text)]
    odd = spark.createDataFrame([(None, None, None, None), (None, 1, "assistant", "x"), (None, 1, "assistant", "x")], schema)
    r = format_pairs(odd, odd.filter("false")).collect()
    assert len(r) == 1 and r[0].chosen.count("<|assistant|>") == 2 and r[0].rejected == ""
    assert format_pairs(odd.filter("false"), odd.filter("false")).count() == 0


def test_reply_pairs_of_odd_rows(spark):
    """Null ids and turns stay; of two last replies the largest text is handed on."""
    from siteledger.llm.preferences import format_pairs, reply_pairs

    rows = [(None, 1, "user", "q"), (None, 2, "assistant", "a"), (4, None, "user", "first"), (4, 1, "assistant", "x"), (4, 1, "assistant", "y"), (5, 1, "assistant", "z"), (6, None, "assistant", "n"), (7, 1, "user", "no reply")]
    got = {r.pair_id: r for r in format_pairs(*reply_pairs(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert set(got) == {None, 4, 5, 6}
    assert "q" in got[None].prompt and "a<|end|>" in got[None].chosen and "a<|end|>" not in got[None].rejected
    assert "first" in got[4].prompt and got[4].rejected.count("z<|end|>") == 2 and "y<|end|>" in got[5].rejected and "n<|end|>" in got[6].chosen


def test_preference_query(spark, small):
    from siteledger.llm.preferences import op9_preferences

    convs = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    reply = {c: max((t for t in turns if t[1] == "assistant"), default=None) for c, turns in convs.items()}
    got = {r.pair_id: r for r in op9_preferences(spark, small).collect()}
    assert set(got) == {c for c, x in reply.items() if x}
    for c, r in got.items():
        upto = [(role, text) for turn, role, text in sorted(convs[c]) if turn <= reply[c][0]]
        other = reply.get(c ^ 1)
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.rejected) == plain_pair(upto, [*upto[:-1], ("assistant", other[2] if other else "")])


# --- 10: quality ----------------------------------------------------------


def plain_statistics(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {x for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for x in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(cover)


def test_quality(spark, small, odd):
    from siteledger.llm.quality_outliers import judge_documents, op10_quality_outliers, reject_outliers

    texts = texts_of(spark, small)
    got = op10_quality_outliers(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        n = plain_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)
    assert sum(r.kept for r in got) > 0.7 * len(got)
    judged = judge_documents(odd).collect()
    assert len(judged) == len(odd_rows()) and all(r.kept is not None for r in judged)
    assert reject_outliers(odd).columns == odd.columns and reject_outliers(empty(spark)).count() == 0


def test_outliers_are_found_by_group(spark):
    from siteledger.llm.quality_outliers import judge_documents

    rng = random.Random(9)
    make = lambda n, noise: " ".join(("#$%" if rng.random() < noise else f"word{rng.randrange(3000)}") for _ in range(n))
    rows = [(i, make(rng.randrange(60, 300), 0), "s") for i in range(300)] + [(1000 + i, make(150, 0.6), "s") for i in range(20)]
    got = {r.doc_id: r.kept for r in judge_documents(frame(spark, rows)).collect()}
    assert sum(got[i] for i in range(300)) >= 297 and not any(got[1000 + i] for i in range(20))


def plain_mcd(z):
    """Squared distances of rows z by group, straight from the definition."""
    from siteledger.llm import quality_outliers as q

    floor = np.array(q.FLOORS)
    cuts = lambda x: np.quantile(np.round(x, 2), [0.25, 0.5, 0.75], axis=0)
    every = cuts(np.concatenate(list(z.values())))
    est = {}
    for g, x in z.items():
        share = len(x) / (len(x) + q.PRIOR_ROWS)
        c = cuts(x) * share + every * (1 - share)
        spread = np.maximum((c[2] - c[0]) / 1.349, floor)
        est[g] = [(c[k], np.diag(1 / spread**2), 0) for k in range(3)]
    far = lambda x, e: np.einsum("ni,ij,nj->n", x - e[0], e[1], x - e[0])

    def step(est):
        near = {}
        for g, x in z.items():
            for k, e in enumerate(est[g]):
                c = np.floor(np.log2(np.clip(far(x, e), q.LEAST, q.MOST)) * q.CLASSES)
                last = min(v for v in set(c) if (c <= v).sum() >= q.SUPPORT * len(x))
                near[g, k] = x[c <= last]
        out = {}
        for g in z:
            out[g] = []
            for k in range(len(est[g])):
                all_ = [near[h, k] for h in z]
                n_all = sum(map(len, all_))
                mean, scatter = np.concatenate(all_).mean(axis=0), sum((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) for x in all_) / n_all
                x, p = near[g, k], q.PRIOR_ROWS
                cov = ((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) + p * scatter) / (len(x) + p) * q.CONSISTENCY
                cov += np.diag(np.maximum(floor**2 - np.diag(cov), 0) + 1e-3 * floor**2)
                out[g].append(((x.sum(axis=0) + p * mean) / (len(x) + p), np.linalg.inv(cov), round(np.linalg.slogdet(cov)[1], 9)))
        return out

    for _ in range(q.TRIAL_STEPS):
        est = step(est)
    est = {g: [min(e, key=lambda x: x[2])] for g, e in est.items()}
    for _ in range(q.LAST_STEPS):
        est = step(est)
    return {g: far(x, est[g][0]) for g, x in z.items()}


def test_verdicts_equal_the_plain_estimate(spark):
    """Two big groups, and small ones down to one row, with odd rows in each."""
    from siteledger.llm.quality_outliers import CUTOFF, DIMS, _transformed, with_distance

    rng = np.random.default_rng(8)
    rows = []
    for g, n in (("a", 400), ("b", 150), ("c", 9), ("d", 3), ("e", 1)):
        for k in range(n):
            words = int(rng.integers(30, 600))
            odd = k % 17 == 0
            rows.append((len(rows), "x", g, words, int(words * (9 if odd and g != "e" else rng.normal(5, 0.4))), int(words * 0.7) if odd else 0, int(rng.integers(0, 2)), int(words * 0.25) if k % 29 == 0 else 0))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    z = {}
    for r in _transformed(stats).orderBy("doc_id").collect():
        z.setdefault(r.source, []).append((r.doc_id, *[r[d] for d in DIMS]))
    want = {}
    for g, d in plain_mcd({g: np.array(x)[:, 1:] for g, x in z.items()}).items():
        want |= {int(x[0]): v for x, v in zip(z[g], d)}
    got = {r.doc_id: r.distance for r in with_distance(stats, ["lang", "source"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want)
    odd, repeats = {r[0] for r in rows if r[5] > 10}, {r[0] for r in rows if r[7]}
    assert all(got[i] > CUTOFF for i in odd if rows[i][2] in "abc")
    assert sum(got[i] <= CUTOFF for i in got if i not in odd | repeats) >= 0.99 * len(got.keys() - odd - repeats)


def test_outliers_go_row_by_row(spark):
    """A rejected row takes no other row of its id with it, null ids included."""
    from siteledger.llm.quality_outliers import reject_outliers

    rng = random.Random(3)
    make = lambda: " ".join(f"word{rng.randrange(3000)}" for _ in range(100))
    good = [(i if i > 5 else None, make(), "s") for i in range(100)]
    bad = [(None, None, "s"), (7, "short", "s"), (8, None, None)]
    got = reject_outliers(frame(spark, good + bad)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in good)


@pytest.mark.parametrize("batch", [1, 100_000])
def test_results_do_not_depend_on_batches(spark, batch):
    """Many short texts, in the smallest batches and in one: the same sets, links and scores."""
    from siteledger.llm.ngram_join import near_duplicates
    from siteledger.llm.pitman_yor import score_documents
    from siteledger.llm.wand_search import top_k

    n = 400 if batch == 1 else 80_000
    rows = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), F.col("id") % (n - n // 16), F.lit(" b"), F.col("id") % (n - n // 16), F.lit(" c")).alias("text"), F.lit(False).alias("held_out"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = near_duplicates(rows, 3, 90).agg(F.sum("n_links").alias("links"), F.max("n_shingles").alias("most"), F.count(F.lit(1)).alias("n")).first()
        assert (got.links, got.most, got.n) == (2 * (n // 16), 1, n)
        q = rows.filter("doc_id in (3, 390)").select(F.col("doc_id").alias("query_id"), "text")
        best = {r.query_id: r.doc_id for r in top_k(rows, q, 2).filter("rank = 2").collect()}
        assert best[3] == 3 + n - n // 16
        tokens = score_documents(rows).agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("m"), F.count(F.lit(1)).alias("n")).first()
        assert (tokens.t, tokens.m, tokens.n) == (4 * n, 4, n)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_shared_folder_on_a_cluster():
    from siteledger.llm.common import shared_dir

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


# --- pipeline -------------------------------------------------------------


@pytest.fixture(scope="module")
def stages(spark, small):
    """The rows that each stage of the pipeline gets, in order, and the last one's result."""
    import corpus_pipeline as p
    from siteledger.llm.common import stored

    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = [docs.collect()]
    for nth, (_, stage) in enumerate(p.STAGES):
        columns, docs = docs.columns, stored(stage(spark, docs, small), "test")
        assert nth == len(p.STAGES) - 1 or docs.columns == columns
        found.append(docs.collect())
    return found


def test_pipeline(stages):
    seen = [len(x) for x in stages]
    assert len(seen) in (5, 6) and seen[0] > seen[1] > seen[2] >= seen[3] > 0.5 * seen[0]


def rows_of(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_pipeline_drops_what_the_plain_noisy_or_calls_toxic(spark, small, stages):
    import pyarrow as pa

    from siteledger.llm.textops import texts
    from siteledger.llm.toxicity import _slots, fit_on

    model = fit_on(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    weight = dict(zip(model.slots.tolist(), model.weights.tolist()))

    def score(text):
        clean = 1.0
        for sentence in re.findall(rb"[^.!?\n]+", (text or "").encode()):
            t = next(iter(texts(pa.array([sentence.decode()]))))
            clean *= 1 / (1 + math.exp(model.bias + sum(weight.get(k, 0.0) for k in set(_slots(t)[0].tolist()))))
        return 1 - clean

    before, after = stages[0], stages[1]
    assert rows_of(after) == rows_of(r for r in before if score(r.text) < 0.5) and len(after) < len(before)


def test_pipeline_drops_what_the_plain_rules_reject(spark, stages):
    from siteledger.llm.quality_outliers import CUTOFF, DIMS, STATS, _transformed

    before, after = stages[1], stages[2]
    stats = [plain_statistics(r.text) for r in before]
    good = [k for k, n in enumerate(stats) if n[0] >= 20 and 100 * n[4] <= 30 * n[0]]
    rows = spark.createDataFrame([(k, *stats[k]) for k in good], "row long, " + ", ".join(f"{s} long" for s in STATS))
    z = {r.row: [r[d] for d in DIMS] for r in _transformed(rows).collect()}
    groups = {}
    for k in good:
        groups.setdefault((before[k].lang, before[k].source), []).append(k)
    far = plain_mcd({g: np.array([z[k] for k in ks]) for g, ks in groups.items()})
    kept = [k for g, ks in groups.items() for k, d in zip(ks, far[g]) if d <= CUTOFF]
    assert rows_of(after) == rows_of(before[k] for k in kept) and len(after) < len(before)


def test_pipeline_keeps_one_of_each_group(stages):
    before, after = stages[2], stages[3]
    found = brute_components({r.doc_id: r.text for r in before}, 5, 80)
    assert rows_of(after) == rows_of(r for r in before if found[r.doc_id][1] == r.doc_id)


def test_pipeline_meets_the_targets(stages):
    before, after = stages[3], stages[4]
    sizes, taken, known = Counter(), Counter(), {}
    for r in before:
        sizes[r.source] += len(WORD.findall(r.text))
        known[r.doc_id] = r
    for r in after:
        whole = known[r.doc_id]
        assert whole.text.startswith(r.text) and [getattr(r, c) for c in r.__fields__ if c != "text"] == [getattr(whole, c) for c in r.__fields__ if c != "text"]
        taken[r.source] += len(WORD.findall(r.text))
    want = shares(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    draws = Counter(r.doc_id for r in after)
    assert max(draws.values()) <= 3
    for s in sizes:  # documents of a source are drawn as often as each other, give or take one
        n = [draws[r.doc_id] for r in before if r.source == s and WORD.search(r.text)]
        assert max(n) - min(n) <= 1
    assert sum(known[r.doc_id].text != r.text for r in after) <= len(sizes)


def test_pipeline_packs_the_ids_of_the_library(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages[4], stages[5]
    t, want, lengths = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter(), []
    for r in before:
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            cut = np.array(ids[at : at + 4096], "<u4")
            lengths.append(len(cut))
            want[r.doc_id, at // 4096, at, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want
    used = {}
    for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert sorted(4096 - n for n in used.values()) == plain_best_fit(lengths, 4096)


def test_pipeline_of_odd_rows(spark, small, odd):
    """Nulls, repeats and clashing columns through every stage, row by row."""
    import corpus_pipeline as p

    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    rows = key(odd)
    stages = [f for _, f in p.STAGES]
    assert key(stages[0](spark, odd, small)) == rows
    long = {k: n for k, n in rows.items() if k[1] and len(WORD.findall(k[1])) >= 20}
    kept = key(stages[1](spark, odd, small))
    assert not kept - Counter(long)  # all others have too few words
    assert key(stages[2](spark, odd, small)) == Counter(dict.fromkeys(rows, 1))
    mixed = stages[3](spark, odd, small)
    assert mixed.columns == odd.columns and {k[0] for k in key(mixed)} <= {k[0] for k in rows}
    pieces = stages[4](spark, odd, small).groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == Counter(i for i, _ in rows.elements())
    for stage in stages:
        assert stage(spark, odd.filter("false"), small).count() == 0
