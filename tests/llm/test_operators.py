"""Every operator on odd rows (nulls, empty and long texts, ties, repeats, empty tables, clashing columns), and beside plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import bpe, decontam, jaccard, langid, linededup, substring, suffixes, tokenfile, topk, urlfilter

R = random.Random(5)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 7))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", ",\n"]) for _ in range(n))


BASE = prose(200, 1)
PASSAGE = prose(70, 2)
TEXTS = [BASE, BASE, BASE.replace("a", "b", 2), None, "", "   \n\t ", "one two three", "one two three", prose(90, 3) + " " + PASSAGE + " " + prose(60, 4), PASSAGE, prose(50, 5) + " " + PASSAGE, prose(49, 6),
         "Überraschung: naïve café 日本語 <|endoftext|> 'tis don't", "x" * 3000, "ab " * 800, prose(4000, 7), BASE.upper(), "1234 5678 !!!", BASE + " end", PASSAGE + " " + PASSAGE, "Page one.\nPage ona.\nPage one.\n\nother line", "Page onn."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ["en", "de", None][i % 3], "s", None) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    t = (text or "").encode()
    return (bytes(b + 32 if lower and 65 <= b <= 90 else b for b in t)).split()


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_token_file_round_trip(spark, docs, none):
    t, start = library(), 0
    got = tokenfile.read_digests(spark, tokenfile.write_tokens(docs)).orderBy("doc_id").collect()
    for row, text in zip(got, TEXTS, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(row) == (row["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.read_digests(spark, tokenfile.write_tokens(none)).count() == 0


def test_token_file_of_odd_ids(spark, monkeypatch):
    """Null ids come first, repeated ids and equal rows are all kept, and starts follow that order, over blocks of few ids."""
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 50)
    rows = [(r, prose(10, 60 + i)) for i, r in enumerate([5, None, 3, 3, None, 1, 9, 7, 5, 2] * 4)] + [(3, BASE), (3, BASE), (None, None), (4, ""), (-8, "Überraschung don't  stop")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).repartition(5)
    got = sorted(map(tuple, tokenfile.read_tokens(spark, tokenfile.write_tokens(df)).collect()), key=lambda x: x[1])
    t = library()
    assert [x[0] for x in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [x[1] for x in got] == np.cumsum([0, *(x[2] for x in got)])[:-1].tolist()
    assert Counter((i, tuple(ids)) for i, _, _, ids in got) == Counter((i, (*t.encode(x or "", add_special_tokens=False).ids, 2)) for i, x in rows)


def test_library_in_long_texts():
    t, r = library(), random.Random(6)
    e = tokenfile.LibraryEncoder(bpe.vocabulary_path())
    some = [" ".join("".join(r.choice("abcdeéß日x'1. ") for _ in range(r.randint(1, 9))) for _ in range(40)) for _ in range(200)]
    assert [x.tolist() for x in e.encode(some)] == [x.ids for x in t.encode_batch(some, add_special_tokens=False)]


def test_library_gets_frequent_words_once(monkeypatch):
    """A full cache lets rare words go and keeps those that came again; ids are the library's all the while."""
    monkeypatch.setattr(bpe, "CACHE_WORDS", 300)
    r = random.Random(41)
    e, asked = tokenfile.LibraryEncoder(bpe.vocabulary_path()), Counter()
    ask = e.words_to_ids
    monkeypatch.setattr(e, "words_to_ids", lambda w: asked.update(w) or ask(w))
    hot = [f" hot{chr(97 + i % 26) * (i % 7 + 1)}" for i in range(40)]
    some = ["".join(hot) + "".join(f" {r.randrange(10**9)}\n{r.randrange(10**9)}" for _ in range(40)) + "".join(hot) for _ in range(20)]
    want = [x.ids for x in library().encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for t in some for x in e.encode([t])] == want
    assert len(e.known) < 700 and {asked[w.encode()] for w in {h.rstrip("0123456789") for h in hot}} == {1}


def test_library_beside_clashing_hashes(monkeypatch):
    """Pre-tokens with one hash are found out by their bytes, and a table of many words grows."""
    r = random.Random(42)
    many = [" ".join(str(r.randrange(10**8)) for _ in range(40_000)), "Überraschung <|endoftext|> 日本", None, "", "it's 'tis\n\n  x"]
    want = [x.ids for x in library().encode_batch([t or "" for t in many], add_special_tokens=False)]
    assert [x.tolist() for x in tokenfile.LibraryEncoder(bpe.vocabulary_path()).encode(many)] == want
    plain = tokenfile.mix
    monkeypatch.setattr(tokenfile, "mix", lambda x, salt=0: plain(x, salt) & np.uint64(0x3FF))
    assert [x.tolist() for x in tokenfile.LibraryEncoder(bpe.vocabulary_path()).encode(many)] == want


def test_code_is_a_limited_prefix_code():
    for counts in ([5], [0, 3, 1], [1] * 1000, [2**i for i in range(40)], list(range(2000))):
        lens = tokenfile.code_lengths(np.array(counts))
        used = lens[lens > 0].astype(int)
        assert (lens > 0).sum() == sum(c > 0 for c in counts) and used.max() <= 16 and sum(2.0**-x for x in used) <= 1
        code = tokenfile.Code(lens)
        ids = np.random.default_rng(1).choice(np.flatnonzero(lens), 777).astype(np.int32)
        assert code.unpack(code.pack(ids), len(ids)).tolist() == ids.tolist()


def test_bpe_as_the_library(docs, none):
    t = library()
    for row in bpe.encode_decode(docs.withColumn("ids", F.lit("clash"))).collect():
        ids = t.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == ids and row["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.token_digests(none).count() == 0
    r, letters = random.Random(3), "aab' 's're\n\t   \x1c\x85é1²,.!日本\U0001F600'll'D x"
    some = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    assert [x.tolist() for x in bpe.Encoder(bpe.vocabulary(bpe.vocabulary_path())).encode(some)] == [e.ids for e in t.encode_batch(some, add_special_tokens=False)]


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return 0 if a == b else 1 if a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] else 2


def test_line_dedup(docs, none):
    r = random.Random(8)
    extra = docs.sparkSession.createDataFrame([(100 + i, "\n".join("".join(r.choice("ab ") for _ in range(r.randint(0, 6))) for _ in range(6)), None, None, 0) for i in range(30)], SCHEMA)
    rows = sorted(linededup.dedup_lines(docs.union(extra).withColumn("gone", F.lit(1))).collect(), key=lambda x: x["doc_id"])
    seen, before = [], {x["doc_id"]: x["text"] for x in docs.union(extra).collect()}
    for row in rows:
        text = before[row["doc_id"]]
        if text is None:
            assert row["text"] is None and row["n_lines"] == 0
            continue
        kept = []
        for line in text.split("\n"):
            key = line.replace("\t", " ").replace("\r", " ").strip(" ")
            if not key or not any(edits(k, key) <= 1 for k in seen):
                kept.append(line)
            if key:
                seen.append(key)
        assert row["text"] == "\n".join(kept) and row["n_removed"] == row["n_lines"] - len(kept), row["doc_id"]
    assert linededup.dedup_lines(none).count() == 0


@pytest.mark.parametrize(("shard", "block", "page"), [(8192, 2048, 2048), (30, 3, 4)])
def test_topk(spark, shard, block, page, monkeypatch):
    for name, value in (("SHARD", shard), ("QUERY_BLOCK", block), ("PAGE", page)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 4) / 8]) for i in range(400)] + [(400, None), (450, []), (500, [1.0, None, 1.0, 1.0]), (550, [float("nan")] * 4), (600, [1.0, 2.0]), (None, [1.0] * 4), (650, [3.0e9, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.topk(df, df.where("vec_id % 50 = 0")).collect()}
    good = {i: [int(x) for x in np.floor(256 * np.array(v))] for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = {}
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want
    assert topk.topk(df.limit(0), df.limit(0)).count() == 0
    tree = topk.Tree(np.arange(400), np.array([good[i] for i in range(400)], float))
    b = tree.bounds(np.array([good[0]], float))[:, 0]
    assert all(b[n] >= (tree.x[r] @ np.array(good[0], float)).max() for n, r in enumerate(tree.rows) if r is not None)


def windows_gone(seqs, k):
    first = {}
    for i in sorted(seqs):
        for s in range(len(seqs[i]) - k + 1):
            first.setdefault(tuple(seqs[i][s : s + k]), i)
    return {i: {p for s in range(len(q) - k + 1) if first[tuple(q[s : s + k])] < i for p in range(s, s + k)} for i, q in seqs.items()}


@pytest.mark.parametrize("shard", [1 << 17, 300])
def test_substring_dedup(docs, none, shard, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_BYTES", shard)
    seqs = {i: words(t) for i, t in enumerate(TEXTS)}
    gone = windows_gone(seqs, 50)
    for row in substring.repeat_digests(docs).collect():
        i = row["doc_id"]
        kept = b" ".join(w for p, w in enumerate(seqs[i]) if p not in gone[i])
        assert tuple(row) == (i, len(seqs[i]), len(gone[i]), hashlib.sha256(kept).hexdigest())
    assert substring.repeat_digests(none).count() == 0


def test_automaton():
    r = random.Random(4)
    for _ in range(30):
        seqs = [[r.randint(0, 2) for _ in range(r.randint(0, 25))] for _ in range(4)]
        a = substring.Automaton()
        for i, s in enumerate(seqs):
            a.add(s, i)
        a.close()
        for k in (1, 3, 5):
            for s in [*seqs, [0, 1, 2, 0, 1, 1, 0]]:
                want = [min((j for j, t in enumerate(seqs) if any(t[x : x + k] == s[p : p + k] for x in range(len(t) - k + 1))), default=2**63 - 1) for p in range(len(s) - k + 1)]
                assert a.stream(s, k) == want


def test_hot_passage_is_split(spark, monkeypatch):
    """One passage in many surroundings and with many small changes: no shard gets more than a bound, and nothing else changes."""
    monkeypatch.setattr(substring, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 20_000)
    r, rows = random.Random(17), []
    for i in range(150):
        own = PASSAGE.split()
        own[r.randrange(len(own))] = r.choice(["x", "yy"])
        rows.append((i, prose(r.randint(0, 5), 9000 + i) + " " + PASSAGE + " " + " ".join(own) + " " + prose(r.randint(0, 60), i % 7)))
    df, sizes = spark.createDataFrame(rows, "doc_id long, text string"), []
    seqs = {i: words(t) for i, t in rows}
    gone = windows_gone(seqs, 50)
    from pulsegrid.llm import anchors

    kept = anchors.keep

    def weighed(table, name):
        out = kept(table, name)
        if name == "contexts":
            sizes.append(out.groupBy("anchor").agg(F.sum(F.octet_length("context")).alias("n")).agg(F.max("n")).first()[0])
        return out

    monkeypatch.setattr(anchors, "keep", weighed)
    assert {x["doc_id"]: x["n_removed"] for x in substring.repeat_digests(df).collect()} == {i: len(g) for i, g in gone.items()}
    byte = {i: t.encode() for i, t in rows}
    count = Counter(b[s : s + 400] for b in byte.values() for s in range(len(b) - 399))
    want = {i: sum(any(count[b[s : s + 400]] > 1 for s in range(max(0, p - 399), min(p, len(b) - 400) + 1)) for p in range(len(b))) for i, b in byte.items()}
    assert {x["doc_id"]: x["n_removed"] for x in suffixes.remove_repeated_bytes(df).collect()} == want
    assert max(sizes) > 40_000 and min(sizes) < 20_000, sizes


def test_substring_dedup_of_odd_ids(spark):
    """Rows of one id are no references for one another; rows without an id keep all and are none either."""
    a, b, c = prose(60, 91) + " " + PASSAGE, PASSAGE + " " + prose(60, 92), prose(60, 93)
    rows = [(1, a), (1, b), (1, a), (2, b), (2, prose(55, 94) + " " + PASSAGE), (None, a), (None, c), (3, c), (4, c + " end"), (0, None), (None, None)]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in out.collect())
    assert got == Counter([(1, 130, 0), (1, 130, 0), (1, 130, 0), (2, 130, 130), (2, 125, 70), (None, 130, 0), (None, 60, 0), (3, 60, 0), (4, 61, 60), (0, 0, 0), (None, 0, 0)])


def test_suffix_dedup_of_odd_ids(spark):
    """Every row counts as a document, whatever its id."""
    a, b = "a" * 5 + prose(90, 95), prose(90, 96)
    rows = [(1, a), (1, b), (None, "x" + b), (2, prose(80, 97)), (None, prose(80, 98)), (3, "same " * 90), (3, "same " * 90), (4, None)]
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("c1", F.lit("clash"))).collect()}
    n = [len(t.encode()) if t else 0 for _, t in rows]
    assert n[1] > 400 and got == {(1, n[0], 0, 0), (1, n[1], n[1], 1), (None, n[1] + 1, n[1], 1), (2, n[3], 0, 0), (None, n[4], 0, 0), (3, 450, 450, 1), (4, 0, 0, 0)}


def test_same_prefix():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    for k in (8, 11, 13):
        order = np.array(sorted(range(len(data) - k), key=lambda i: data[i:].tobytes()))
        assert suffixes.same_prefix(data, order, k).tolist() == [data[x : x + k].tobytes() == data[y : y + k].tobytes() for x, y in zip(order[:-1], order[1:])]


@pytest.mark.parametrize("shard", [1 << 20, 500])
def test_suffix_dedup(docs, none, shard, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", shard)
    data = {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    count = Counter(b[s : s + 400] for b in data.values() for s in range(len(b) - 399))
    for row in suffixes._cut(docs, "kept_sha256 string", lambda k: hashlib.sha256(k).hexdigest(), suffixes.pa.string()).collect():
        b = data[row["doc_id"]]
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 399):
            if count[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        runs = sum(gone[p] and (p == 0 or not gone[p - 1]) for p in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert tuple(row) == (row["doc_id"], len(b), gone[:-1].sum(), runs, hashlib.sha256(kept).hexdigest()), row["doc_id"]
    assert suffixes.remove_repeated_bytes(none).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(150):
        s = rng.integers(1, rng.choice([2, 3, 200]), rng.integers(0, 70))
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def components(sets, least=80):
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: find(i) for i in sets}


def shingle_set(text, short=True):
    w = words(text, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w and short else set()


@pytest.mark.parametrize(("hot", "chunk"), [(12, 2048), (2, 2048), (2, 5)])
def test_jaccard_components(spark, docs, none, hot, chunk, monkeypatch):
    """Families of near copies, small and large; with low bounds all go the longer way, in one chunk or several."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    r, rows = random.Random(9), list(enumerate(TEXTS))
    for f in range(6):
        stem = prose(R.randint(5, 60), 100 + f).split(" ")
        for _ in range(20):
            own = list(stem)
            for _ in range(r.randint(0, max(1, len(own) // 25))):
                own[r.randrange(len(own))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows] + [(None, BASE, None, None, 0)], SCHEMA)
    got = {x["doc_id"]: x for x in jaccard.jaccard_components(df).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    want = components(sets)
    assert got.pop(None)["component_id"] == 0
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    if hot == 12:
        assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_of_odd_ids(spark):
    """Rows of one id keep their own texts' components; rows without an id link like others."""
    other = prose(80, 51)
    rows = [(1, BASE), (1, other), (2, BASE + " end"), (1, BASE), (None, other), (None, prose(80, 52)), (None, None), (3, None), (2, prose(80, 53))]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = [len(shingle_set(t)) for _, t in rows]
    assert got == Counter(zip([i for i, _ in rows], n, [1, 1, 1, 1, 1, None, None, 3, 2], strict=True))


def test_url_filters(spark):
    urls = ["http://A.Example.com/en/7x?q#f", "https://example.com/en/1", "ftp://net/de/8", "x://example.net/de/81", "x://b.a.org/es/", None, "no scheme", "://", "x://com", "x://telecom/en/", "x://COM?/en/", "x://a.com/EN/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = [tuple(r)[2:] for r in urlfilter.filter_urls(df, urlfilter.RULES).orderBy("page_id").collect()]
    want = []
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        rest = rest.split("?")[0].split("#")[0]
        host, path = rest.split("/", 1)[0].lower(), "/" + rest.split("/", 1)[1] if "/" in rest else ""
        fit = [(len(h), len(p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((host, path, *(max(fit)[2:] if fit else (None, "allow"))))
    assert got == want
    monkey = urlfilter.RULE_BLOCK
    urlfilter.RULE_BLOCK = 2
    assert [tuple(r)[2:] for r in urlfilter.filter_urls(df, urlfilter.RULES).orderBy("page_id").collect()] == want
    urlfilter.RULE_BLOCK = monkey
    assert urlfilter.filter_urls(df.limit(0), []).count() == 0


def test_url_filters_of_odd_rows(spark):
    """Long urls, repeated rows, hosts beyond ASCII, and columns with clashing names."""
    long = "https://a." + "b" * 100_000 + ".com/en/" + "c" * 100_000
    urls = [(1, long), (1, long), (None, "x://ÀÉ.COM/en/1"), (2, "x://net/de/" + "d" * 5000), (3, "x://../en/")]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "verdict")})
    got = sorted(((r["page_id"] or 0, r["host"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(df, urlfilter.RULES).collect()), key=str)
    assert got == sorted([(1, long[8:].split("/")[0], "com/en/", "block")] * 2 + [(0, "ÀÉ.com", "com/en/", "block"), (2, "net", "net/de/", "allow"), (3, "..", None, "allow")], key=str)
    rules = [("block", "ÀÉ.Com", "/en/")]
    assert [r["verdict"] for r in urlfilter.filter_urls(df.where("page_id is null"), rules).collect()] == ["block"]


def test_bpe_in_blocks(spark, docs, monkeypatch):
    """Blocks of few characters and a clash of n_tokens change nothing."""
    want = {r["doc_id"]: r["ids_sha256"] for r in bpe.token_digests(docs).collect()}
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 100)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    e = bpe.Encoder(bpe.vocabulary(bpe.vocabulary_path()))
    assert {i: hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for i, x in enumerate(e.encode(TEXTS))} == want
    got = bpe.token_digests(docs.withColumn("n_tokens", F.lit("clash")).unionByName(docs.withColumn("n_tokens", F.lit("clash")).where("doc_id = 1")))
    assert got.count() == len(TEXTS) + 1 and dict(got.dtypes)["n_tokens"] == "bigint"


def test_topk_leaves_far_shards_out(spark, monkeypatch):
    """Rows in clusters: the boxes of far clusters send no tree, and the answer is that of all rows."""
    monkeypatch.setattr(topk, "SHARD", 50)
    rng, kept = np.random.default_rng(8), {}
    x = np.repeat(rng.normal(size=(16, 8)) * 4, 60, axis=0) + rng.normal(size=(960, 8)) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    keep = topk.keep

    def counted(table, name):
        out = keep(table, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(topk, "keep", counted)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.topk(df, df.where("vec_id % 50 = 0")).collect()}
    whole = np.floor(256 * x).astype(np.int64)
    for q in range(0, 960, 50):
        score = whole @ whole[q]
        best = sorted((-score[i], i) for i in range(960) if i != q)[:5]
        assert [got[q, n] for n in range(1, 6)] == [(i, -s) for s, i in best]
    blocks, trees, pairs = (kept[n] for n in ("queries", "trees", "pairs"))
    assert trees >= 16 and pairs < 0.25 * blocks * trees


def test_topk_of_odd_rows(spark):
    """Repeated rows are candidates each; ties between them go by vec_id."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, None), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("clash"))
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in topk.topk(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 8, 131072), (0, 7, 65536), (0, 7, 65536)]


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(PASSAGE.split()[:40]).upper()), (2, None), (3, "a b c"), (6, "one TWO three"), (None, PASSAGE), (4, prose(30, 77)), (1, PASSAGE[:50]), (5, " ".join(prose(4000, 7).split()[2000:2030]))]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, df).collect()}
    want = {(i, n) for i, t in enumerate(TEXTS) for n, item in items if n is not None and (s := shingle_set(item)) and len(s & shingle_set(t)) >= 0.8 * len(s)}
    assert got == want and any(n == 5 for _, n in got)
    assert decontam.contaminated(none, df).count() == 0 and decontam.contaminated(docs, df.limit(0)).count() == 0


def test_language_id(spark, docs, none):
    alphabets = {"xx": "abcde", "yy": "vwxyz", "zz": "éèàçù"}
    rows = [(i, " ".join("".join(R.choice(alphabets[k]) for _ in range(5)) for _ in range(20)), k) for i, k in ((i, ["xx", "yy", "zz"][i % 3]) for i in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    held = langid.held_out()
    model = langid.train(df.where(~held))
    out = langid.predict(df.withColumn("held", held), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in out if r["held"]) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["held"] for r in out} == {True, False} and all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert odd[3] == odd[4] == odd[17] == "und" and odd[0] != "und"
    assert langid.predict(docs, langid.train(none)).where("lang_pred <> 'und'").count() == 0 and langid.predict(none, model).count() == 0


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_language_id_beside_plain_naive_bayes(spark, piece, monkeypatch):
    """Every posterior beside sums over a dictionary of n-grams; texts longer than a piece, letters beyond ASCII, overlapping alphabets."""
    r, alphabets = random.Random(11), {"aa": "abcdeé", "bb": "cdefgü", "cc": "efghiß日"}
    line = lambda k, n: "".join(r.choice(alphabets[k] + " .,\n1") for _ in range(n))
    learned = [(i, line(k, 120), k) for i, k in enumerate(["aa", "bb", "cc"] * 20)]
    asked = [(100 + i, line(k, r.choice([1, 2, 5, 40, 600])), k) for i, k in enumerate(["aa", "bb", "cc"] * 20)] + [(300, "ABC", "aa"), (301, "123 !", None), (302, None, None)]
    model = langid.train(spark.createDataFrame(learned, "doc_id long, text string, lang string"))

    def grams(text):
        c = [x if x.isalpha() else " " for x in (text or "").lower()]
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                if any(x != " " for x in c[i : i + n]):
                    h = n
                    for x in c[i : i + n]:
                        h = (h * 0x100000001B3 + ord(x)) % 2**64
                    yield h * 0x9E3779B97F4A7C15 % 2**64 >> 48

    counts = {k: Counter(g for _, text, own in learned if own == k for g in grams(text)) for k in alphabets}
    total = {k: sum(c.values()) for k, c in counts.items()}
    monkeypatch.setattr(langid, "PIECE", piece)
    best, score = model.scores([text for _, text, _ in asked])
    for (_, text, _), b, s in zip(asked, best, score, strict=True):
        own = list(grams(text))
        logs = {k: sum(np.log((counts[k][g] + 0.5) / (total[k] + 0.5 * 65536)) for g in own) for k in counts}
        share = {k: np.exp(v - max(logs.values())) for k, v in logs.items()}
        want = max(sorted(share), key=share.get) if own else "und"
        assert b == want and (not own or abs(s - share[want] / sum(share.values())) < 1e-9)


def test_language_id_ties(spark):
    """The same texts in two languages: the one that sorts first wins; null ids are predicted and not held out."""
    rows = [(i, "same words", k) for i, k in enumerate(["zz", "aa"] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(None, "same"), (1, "words"), (1, "words")], "doc_id long, text string")
    got = langid.predict(asked, langid.train(df)).collect()
    assert [(x["lang_pred"], round(x["score"], 6)) for x in got] == [("aa", 0.5)] * 3


def test_pipeline_beside_a_plain_version(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(1, " ".join(PASSAGE.split()[:30]))], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, folder).collect()}
    left, seen = {}, []
    for i, t in enumerate(TEXTS):
        if t and langid.has_letter(t):
            kept = []
            for line in t.split("\n"):
                key = line.strip(" ")
                if not key or not any(edits(k, key) <= 1 for k in seen):
                    kept.append(line)
                if key:
                    seen.append(key)
            if "".join(kept).strip():
                left[i] = "\n".join(kept)
    comp = components({i: shingle_set(t) for i, t in left.items()})
    item = shingle_set(" ".join(PASSAGE.split()[:30]))
    left = {i: t for i, t in left.items() if comp[i] == i and len(item & shingle_set(t)) < 0.8 * len(item)}
    assert got == {i: len(library().encode(t, add_special_tokens=False).ids) for i, t in left.items()}


@pytest.mark.parametrize("few", [1, 6, 1000])
def test_shared_counts(few, monkeypatch):
    """Intersections of sets with one another, entries counted pair by pair and by products."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(5)
    sets = [rng.choice(60, rng.integers(0, 30), replace=False).astype(np.uint64) for _ in range(40)]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(40), [len(x) for x in sets])
    want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    assert (jaccard.shared_counts(flat, owner, 40, 0) == want).all()
    assert (jaccard.shared_counts(flat, owner, 40, 13) == want[:13, 13:]).all()


def test_line_dedup_of_long_lines(spark):
    """Lines of 14 to 2000 characters one edit apart, at every kind of place and around the lengths where ends and parts change."""
    r = random.Random(12)
    rows, seen, want = [], [], {}
    for n in (14, 15, 16, 17, 31, 32, 33, 62, 63, 64, 65, 66, 95, 96, 97, 127, 128, 129, 130, 300, 511, 512, 513, 2000):
        stem = "".join(r.choice("abcdefgh") for _ in range(n))
        lines = [stem]
        for at in sorted({0, 1, n // 4, n // 2 - 1, n // 2, n // 2 + 1, n - 1, *(x for x in (31, 32, 33, 63, 64, 65) if x < n)}):
            lines += [stem[:at] + "X" + stem[at + 1 :], stem[:at] + "Y" + stem[at:], stem[:at] + stem[at + 1 :], stem[:at] + "Z" + stem[at:][::-1]]
        r.shuffle(lines)
        rows.append((len(rows), "\n".join(lines), None, None, 0))
    rows += [(100 + i, t, None, None, 0) for i, t in enumerate(TEXTS)]
    for i, text, *_ in rows:
        kept = []
        for line in (text or "").split("\n"):
            key = line.replace("\t", " ").replace("\r", " ").strip(" ")
            if not key or not any(edits(k, key) <= 1 for k in seen):
                kept.append(line)
            if key:
                seen.append(key)
        want[i] = None if text is None else "\n".join(kept)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {x["doc_id"]: x["text"] for x in linededup.dedup_lines(df).collect()} == want


def test_line_dedup_of_odd_ids(spark):
    """Rows of one id and different texts are documents of their own, a null id sorts first, equal rows share their fate."""
    rows = [(1, "same line"), (1, "other line"), (2, "same line\nnew"), (None, "same line"), (None, "third one"), (1, "other line"), (4, None), (4, "")]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_removed": F.lit("clash"), "_key": F.lit("clash")}))
    assert {r["_key"] for r in out.collect()} == {"clash"}
    got = Counter((r["doc_id"], r["text"], r["n_lines"]) for r in out.collect())
    assert got == Counter([(1, "", 1), (1, "other line", 1), (1, "other line", 1), (2, "new", 2), (None, "same line", 1), (None, "third one", 1), (4, None, 0), (4, "", 1)])


def test_jaccard_components_across_a_band_border(spark):
    """Templates of 36 shingles in many slightly longer copies, and one copy of 31 shingles that links to the template alone."""
    r, rows, want = random.Random(31), [], {}
    for _ in range(60):
        stem, sets = [r.choice(WORDS) for _ in range(40)], {}
        cut = r.randint(0, 5)
        short = stem[cut : 35 + cut]
        short[r.choice([0, -1])] = "new"
        for own in [stem, short, *([f"w{k}", *stem] if k % 2 else [*stem, f"w{k}"] for k in range(30))]:
            rows.append((len(rows), " ".join(own), None, None, 0))
            sets[len(rows) - 1] = shingle_set(rows[-1][1])
        want |= components(sets)
    got = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_decontamination_finds_small_items():
    """Items of 1 to 12 shingles that stand whole inside long documents."""
    texts = [prose(400, 1000 + n) for n in range(100)]
    spans = [(n, at, 5 + k % 12 if k % 2 else 5) for n in range(100) for k, at in enumerate(range(0, 380, 19))]
    known = decontam.Items(list(range(len(spans))), pa.array([" ".join(texts[n].split()[at : at + k]) for n, at, k in spans]))
    h, first = decontam.word_hashes(*decontam.raw(pa.array(texts)), True)
    found = decontam.candidates(*decontam.shingles(h, first, 5, short=False), known)
    assert {(n, i) for i, (n, _, _) in enumerate(spans)} <= found


def test_decontamination_recall():
    """Items of which four fifths or more stand in long documents, with words replaced, left out or put in, beside the exact rule."""
    r = random.Random(21)
    stems = [prose(r.randint(20, 120), 3000 + n).split() for n in range(300)]
    texts = []
    for n, stem in enumerate(stems):
        own, edits_ = list(stem), r.randint(0, max(1, len(stem) // 30))
        for _ in range(edits_):
            own[r.randrange(len(own))] = r.choice(["new", "new other", ""])
        texts.append(prose(r.randint(50, 800), 5000 + n) + " " + " ".join(own) + " " + prose(r.randint(50, 800), 7000 + n))
    known = decontam.Items(list(range(len(stems))), pa.array([" ".join(x) for x in stems]))
    got = {(row, i) for row, i, *_ in decontam.held(pa.array(texts), known, 0.8)}
    want = {(n, n) for n, stem in enumerate(stems) if len((s := shingle_set(" ".join(stem))) & shingle_set(texts[n])) >= 0.8 * len(s)}
    assert len(want) > 150 and got <= want and len(got) >= 0.99 * len(want)


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    """Blocks of items give the same pairs; rows without doc_id and repeated rows are judged one by one; other columns pass."""
    items = spark.createDataFrame([(n, prose(30, 900 + n)) for n in range(6)], "item_id long, text string")
    rows = [(1, "x " + prose(30, 901)), (1, "x " + prose(30, 901)), (None, prose(30, 903)), (None, prose(60, 1)), (2, None), (3, prose(60, 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("clash"))
    monkeypatch.setattr(decontam, "ITEM_BYTES", 100)
    assert Counter((x["doc_id"], x["item_id"]) for x in decontam.contaminated(df, items).collect()) == Counter([(1, 1), (1, 1), (None, 3)])
    left = decontam.without_items(df, items)
    assert left.columns == df.columns and Counter((x["doc_id"], x["text"]) for x in left.collect()) == Counter(rows[3:])


def test_pipeline_of_odd_ids(spark, tmp_path):
    """Rows are known by id and text: near copies go, whatever their ids; rows that share an id but not the text are kept; items count in all rows."""
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    other, held = prose(80, 41), prose(40, 42) + " " + PASSAGE
    rows = [(1, BASE), (None, BASE), (None, other + " x"), (2, BASE + " end"), (3, other), (3, other), (4, other), (1, prose(80, 43)), (6, BASE), (None, held), (None, None), (7, held), (None, prose(70, 44)), (None, prose(70, 45))]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    stay = [(1, BASE), (3, other), (1, prose(80, 43)), (None, None), (7, held), (None, prose(70, 44)), (None, prose(70, 45))]
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(stay)
    clean = corpus_pipeline.decontaminate(spark, left, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter(x for x in stay if x[1] != held)
    five = spark.createDataFrame([(1, BASE, "en"), (1, other, "en"), (2, BASE, "en"), (None, BASE, "en"), (None, prose(70, 44), "en")], "doc_id long, text string, lang string").withColumns({"_key": F.lit("clash"), "_pred": F.lit("clash"), "gone": F.lit(1), "source": F.lit("s")})
    folder = tmp_path / "five"
    five.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(folder)).count() == 3
    five.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
