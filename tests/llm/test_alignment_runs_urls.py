"""Small cases and brute-force versions of operators 11 to 13, and texts of megabytes
through operators and pipeline stages."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, n_words string, runs int, part double, chunk long, links int, base int"


def odd_rows():
    """Nulls, empty and blank texts, repeated ids and rows, odd characters, a long text."""
    long = " ".join(f"w{n % 977}" for n in range(20_000)) + " and then " + "do it " * 3000
    texts = [(1, "a b a b a b a b a b a b a b"), (1, "a b a b a b a b a b a b a b"), (2, None), (3, ""), (4, " \t\n "), (None, "x y z"), (5, long), (5, "other  text "), (6, "é 日本 \x01 . <|endoftext|> <s> \r\n"), (7, "a▁b"), (8, "x" * 5000)]
    return [(i, t, "n", 7, 1.5, 3, 4, 5) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


def docs_of(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- 12: periodic runs -----------------------------------------------------


def plain_runs(w, least=12):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        k = q
        while k < len(w):
            if w[k] != w[k - q]:
                k += 1
                continue
            j = k
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - k >= q and j - k + q >= least:
                best.setdefault((k - q, j), q)
            k = j
    return sorted((s, e - s, q) for (s, e), q in best.items())


def test_catchers_equal_brute_force_at_any_pace():
    """Several sequences at once, appended by one word, a few, or all."""
    from siteledger.llm.periodic_runs import Catchers

    rng = random.Random(5)
    for _ in range(400):
        seqs = []
        for _ in range(rng.randint(0, 5)):
            n, v = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 10])
            w = [rng.randrange(v) for _ in range(n)]
            if rng.random() < 0.4 and n:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            seqs.append(w)
        least, step = rng.choice([2, 12]), rng.choice([1, 2, 3, 7, 30, 1000])
        c = Catchers(np.array([x for w in seqs for x in w], np.int64), np.array([len(w) for w in seqs], np.int64), least)
        while c.append(step):
            pass
        got = [[] for _ in seqs]
        for s, a, e, p in zip(*c.runs()):
            got[s].append((int(a - c.first[s]), int(e - a), int(p)))
        assert got == [plain_runs(w, least) for w in seqs]


def test_long_texts_of_one_and_of_many_words():
    from siteledger.llm.periodic_runs import Catchers

    for words, want in ((np.zeros(300_000, np.int64), [(0, 300_000, 1)]), (np.arange(300_000) % 7, [(0, 300_000, 7)]), (np.arange(300_000), [])):
        c = Catchers(words, np.array([len(words)]))
        while c.append():
            pass
        assert [(int(a), int(e - a), int(p)) for _, a, e, p in zip(*c.runs())] == want


def plain_digest(i, text):
    w = WORD.findall(text or "")
    n = len(w)
    if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    inside = {k for s, l, q in runs for k in range(s + q, s + l)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, sha("".join(f"{s},{l},{q}\n" for s, l, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in inside)))


def test_op12_equals_brute_force(spark, small):
    from siteledger.llm.periodic_runs import op12_periodic_runs

    got = {r.doc_id: tuple(r)[1:8] for r in op12_periodic_runs(spark, small).collect()}
    docs = docs_of(spark, small)
    assert len(got) == len(docs) and sum(g[0] for g in got.values()) > 10
    for i, text in docs:
        if len(text or "") < 20_000:
            assert got[i] == plain_digest(i, text), i


def test_runs_of_odd_rows(spark, odd):
    from siteledger.llm.periodic_runs import periodic_runs, planted

    rows = periodic_runs(odd).collect()
    assert len(rows) == odd.count()
    got = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed) for r in rows}
    assert got[1, 14] == ([(0, 14, 2)], "a b") and sum(r.doc_id == 1 for r in rows) == 2
    assert got[2, 0] == got[3, 0] == got[4, 0] == ([], "")
    assert got[None, 3] == ([], "x y z")
    assert [x for x in got[5, 26_002][0] if x[2] == 2] == [(20_002, 6000, 2)] and (0, 20_000, 977) in got[5, 26_002][0]
    assert periodic_runs(odd.filter("false")).count() == 0 and planted(odd.filter("false")).count() == 0
    assert planted(odd).filter("doc_id is null").first().text == "x y z"


# --- 13: addresses ---------------------------------------------------------


def test_op13_hosts_paths_and_rules(spark):
    from siteledger.llm.url_filter import judge_urls

    cases = {
        "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/EN/1": ("example.net", "/EN/1", "net/", "block"),
        "https://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "https://b.net": ("b.net", "", None, "allow"),
        "https://b.net?/x": ("b.net", "", None, "allow"),
        "ftp://x.example.com/de/#a/b": ("x.example.com", "/de/", "example.com/de/", "block"),
        "http://w.org/fr/casino": ("w.org", "/fr/casino", "org/fr/", "allow"),
        "http://w.org/frx/": ("w.org", "/frx/", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "no address": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://É.Com/ÀB": ("É.com", "/ÀB", None, "allow"),
        "http://x.com/a\nb/c": ("x.com", "/a\nb/c", None, "allow"),
    }
    rows = spark.createDataFrame([(n, u) for n, u in enumerate(cases)], "page_id long, url string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in judge_urls(rows).orderBy("page_id").collect()]
    assert got == list(cases.values())


def test_op13_terms_stand_alone(spark):
    from siteledger.llm.url_filter import judge_urls

    cases = {
        "http://x.com/CASINO": ("block", ["casino"]), "http://x.com/casinoworld": ("allow", []), "http://x.com/1casino": ("allow", []), "http://x.com/écasino": ("allow", []),
        "http://x.com/my_casino-hall": ("block", ["casino"]), "http://cheap.x.com/cheap/cheap": ("allow", ["cheap"]), "http://cheap-pills.x.com/": ("block", ["cheap", "pills"]),
        "casino": ("block", ["casino"]), "http://x.com/" + "a/" * 100_000 + "free/bets": ("block", ["bets", "free"]), None: ("allow", []),
    }
    rows = spark.createDataFrame([(n, u, "kept out") for n, u in enumerate(cases)] + [(0, "http://x.com/CASINO", "again")], "page_id long, url string, terms string")
    got = judge_urls(rows).orderBy("page_id").collect()
    assert [(r.verdict, r.terms) for r in got] == [cases["http://x.com/CASINO"], *cases.values()]
    assert judge_urls(rows.filter("false")).count() == 0
    assert judge_urls(rows, {}).filter("verdict = 'block'").count() == 0


# --- 11: alignment ---------------------------------------------------------


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    from siteledger.llm import alignment

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return paths, alignment.vocabulary(paths[0], "bytes"), alignment.vocabulary(paths[1], "pieces")


def plain_alignment(files, text):
    """n_a, n_b, n_groups, n_links, groups and links by the plain libraries and two loops."""
    from tokenizers import Tokenizer

    (path, _), a, b = files
    if not hasattr(plain_alignment, "tokenizer"):
        plain_alignment.tokenizer = Tokenizer.from_file(path)
        plain_alignment.tokenizer.encode_special_tokens = True
        plain_alignment.bytes = a.token.to_pylist(), b.token.to_pylist()
    none = (0, 0, 0, 0, "", [])
    if not text:
        return none
    x, y = plain_alignment.tokenizer.encode(" " + text, add_special_tokens=False).ids, b.encoder.model.encode(text)
    of_a, of_b = plain_alignment.bytes
    want = b" " + text.encode()
    if b"".join(of_a[i] for i in x) != want or b"".join(of_b[i] for i in y) != want:
        return none
    end_a, end_b = np.cumsum([len(of_a[i]) for i in x]).tolist(), np.cumsum([len(of_b[i]) for i in y]).tolist()
    cuts = set(end_a) & set(end_b)
    groups, links, xs, ys, j, start = [], [], [], [], 0, 0
    for i, end in enumerate(end_a):
        xs.append(x[i])
        while j < len(y) and (end_b[j - 1] if j else 0) < end:
            links.append((x[i], y[j]))
            if end_b[j] <= end:
                ys.append(y[j])
                j += 1
            else:
                break
        if end in cuts:
            groups.append(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)))
            xs, ys = [], []
    return len(x), len(y), len(groups), len(links), ";".join(groups), links


def test_alignment_equals_the_plain_libraries(files):
    from siteledger.llm.alignment import align_texts

    rng = random.Random(4)
    bits = ["a", " ", "  ", "\n", "\t", "<|endoftext|>", "<s>", "▁", "é", "日本", "\x00", "\x01", "İ", "don't", "hello", "1234", "ﬁ", "　", "\xa0", "́", "</s>", "<0x41>", "Word", "...", "\r\n", "😀", "https://x.y/z?q=1", "ALLCAPS", " \n "]
    for _ in range(150):
        texts = [None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 20))]
        got = align_texts(texts, *files[1:])
        pairs = [(p >> 16, p & 0xFFFF) for p in got.pairs.to_pylist()]
        at = 0
        for k, text in enumerate(texts):
            n = int(got.n_links[k])
            assert (int(got.n_a[k]), int(got.n_b[k]), int(got.n_groups[k]), n, got.groups[k].as_py(), pairs[at : at + n]) == plain_alignment(files, text), text
            at += n


def expected(files, docs):
    found = [(i, plain_alignment(files, t)) for i, t in docs]
    count = Counter(x for _, p in found for x in p[5])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted((str(i), *p[:4], sum(count[x] == best[x[1]] for x in p[5]), sum(count[x] for x in p[5]), p[4]) for i, p in found), count


def test_op11_equals_brute_force(spark, small, files, monkeypatch):
    """Counts over chunks of many documents, with small chunks and rows of pairs."""
    from siteledger.llm import alignment

    monkeypatch.setattr(alignment, "CHUNK_BYTES", 50_000)
    monkeypatch.setattr(alignment, "ROW_PAIRS", 100)
    want, _ = expected(files, docs_of(spark, small))
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in alignment.op11_alignment(spark, small).collect())
    assert got == [(*w[:-1], sha(w[-1]) if w[1] else "") for w in want]
    assert sum(w[4] for w in want) > 10_000


def test_alignment_of_odd_rows(spark, odd, files):
    from siteledger.llm.alignment import align

    by_doc, pairs = align(odd, *files[0])
    want, count = expected(files, [(r.doc_id, r.text) for r in odd.collect()])
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in by_doc.collect())
    assert got == want and {w[0] for w in want if not w[1]} == {"2", "3", "7"}
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == dict(count)
    none, no_pairs = align(odd.filter("false"), *files[0])
    assert none.count() == 0 and no_pairs.count() == 0


# --- very long texts -------------------------------------------------------


@pytest.fixture(scope="module")
def long_docs(spark):
    """Two near copies of five megabytes, and short texts."""
    rng = random.Random(9)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(40_000)}" for _ in range(760_000)]
    text = " ".join(words)
    assert len(text) > 5_000_000 - 500_000
    near = " ".join([*words[:-5], "and", "now", "it", "ends"])
    rows = [(1, text, "en", "s"), (2, near, "en", "s"), (3, "a b c d e", "en", "s"), (4, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_megabytes_through_stages(spark, long_docs, files):
    import corpus_pipeline as p
    from siteledger.llm.ngram_join import near_duplicates
    from siteledger.llm.packing import SEQUENCE

    linked = {r.doc_id: r.component_id for r in near_duplicates(long_docs, 3, 90).collect()}
    assert linked[1] == linked[2] == 1 and linked[3] == 3
    kept = p.near_duplicates(spark, long_docs, "")
    assert {r.doc_id for r in kept.select("doc_id").collect()} in ({1, 3, 4}, {2, 3, 4})
    mixed = p.mixing(spark, kept, "")
    assert mixed.columns == long_docs.columns and mixed.filter("length(text) > 1000000").count() >= 1
    pieces = p.packing(spark, kept, "").collect()
    long_id = next(r.doc_id for r in kept.filter("doc_id < 3").select("doc_id").collect())
    own = sorted((r.piece, r.start, r.length) for r in pieces if r.doc_id == long_id)
    assert [s for _, s, _ in own] == [n * SEQUENCE for n in range(len(own))] and all(n == SEQUENCE for _, _, n in own[:-1]) and sum(n for _, _, n in own) > 1_000_000


def test_megabytes_through_files_and_runs(spark, long_docs, files, tmp_path):
    from tokenizers import Tokenizer

    from siteledger.llm.alignment import align
    from siteledger.llm.periodic_runs import periodic_runs
    from siteledger.llm.sorted_shards import read_shards, write_shards

    (path, pieces), _, _ = files
    text = long_docs.filter("doc_id = 1").first().text
    n = len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    got = {r.doc_id: r.n_tokens for r in read_shards(write_shards(long_docs, path, 0, f"file://{tmp_path}/s")).collect()}
    assert got[1] == n + 1 and got[4] == 1
    by_doc, _ = align(long_docs.filter("doc_id <> 2"), path, pieces, None)
    rows = {r.doc_id: r for r in by_doc.drop("groups").collect()}
    assert rows[1].n_links == rows[1].n_a + rows[1].n_b - rows[1].n_groups and rows[1].n_a >= n and rows[4].n_a == 0
    runs = {r.doc_id: (r.n_words, len(r.runs)) for r in periodic_runs(long_docs).select("doc_id", "n_words", "runs").collect()}
    assert runs[1] == (760_000, 0) and runs[4] == (0, 0)
