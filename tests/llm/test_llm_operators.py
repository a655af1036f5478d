"""The training-data operators against brute force on small tables, and on the edge cases their docstrings name."""

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kelpgrid.llm import exact, gam, mixing, packing, quality_rules, queries, sharding, simhash, suffix, token_files, url_rules
from kelpgrid.llm.encoding import Encoder, byte_bpe, word_bpe
from kelpgrid.session import materialize

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, shard int, part int, hash long, n_tokens string"
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(140))


def edge_rows():
    texts = [None, "", "  \n\t ", "one", "One", "two words", "a b c d e f", "a b c d e f", LONG, LONG.upper(), PASSAGE, f"before {PASSAGE} after",
             f"É{PASSAGE}ß", "x  y\n z <|endoftext|> q", "日本 語 ÀB àb", "% # $ | < >", PASSAGE.replace("p7 ", "q7 ")]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", None][i % 2], 1, 0.5, "k", 7, 3, 9, "n") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[10], (None, "no id", None, None, None, None, None, None, None, None, None), (None, None, "en", "s1", 0, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def canon(rows):
    return sorted(map(repr, rows))


# --- 1

def brute_measures(text):
    text = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    hit = {i + k for i in range(len(ws) - 4) if seen[tuple(ws[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(ws)
    return (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n)


def test_quality_rules(docs, edge, empty):
    for df in (docs, edge):
        got = quality_rules.judge(df).select("doc_id", *quality_rules.BASE_MEASURES, "base_failed").collect()
        assert canon(tuple(r) for r in got) == canon((i, *brute_measures(t)) for i, t in pairs(df))
    rows = quality_rules.judge(docs).select("kept", "base_failed").collect()
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality_rules.judge(empty).count() == 0


def test_quality_rules_keep_good_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.judge(docs).filter("n_words >= 10").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = {r[0]: r[1] for r in got}
    assert share[1] > 0.95 and share[0] < 0.5


# --- 2 and 9

def library_ids(vocabulary, text, end):
    return Encoder(vocabulary).full.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_token_files(spark, request, table):
    df = request.getfixturevalue(table)
    v, folder = byte_bpe(queries.vocabulary_file("byte_bpe_50k.json")), token_files.new_folder(spark)
    manifest = token_files.write_token_files(df, v, folder)
    got = token_files.read_token_files(manifest, folder).collect()
    full, at, want = Encoder(v).full, 0, []
    for i, t in sorted(pairs(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = full.encode(t or "", add_special_tokens=False).ids + [token_files.END]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert canon(tuple(r) for r in got) == canon(want)
    row = manifest.orderBy("part").first()
    ids, off, doc = token_files.open_tokens(folder, row["name"], row["width"])
    assert isinstance(ids, np.memmap) and len(off) == len(doc) + 1 and off[-1] == len(ids)


def test_token_files_empty(spark, empty):
    folder = token_files.new_folder(spark)
    manifest = token_files.write_token_files(empty, byte_bpe(queries.vocabulary_file("byte_bpe_50k.json")), folder)
    assert token_files.read_token_files(manifest, folder).count() == 0


@pytest.mark.parametrize("make, name", [(byte_bpe, "byte_bpe_50k.json"), (word_bpe, "word_bpe_49k.json")])
def test_encoder_matches_library(make, name):
    texts = ["", "  a b", " a", "a ", "a\n b", "a \nb", "it's  'tis we'll 3 45 don't", "é É ﬁ ß", "a ́b <|endoftext|> c", "\0 a \0b", "日本 語 x",
             "a\tb c\x1cd e\x85f", None, "Σας ΟΔΥΣΣΕΥΣ ΑΣ Σ a", "'S 'LL X'S", "a\xa0 b", "xx² 1½ a¼", "e\u0301, e\u0301. x", *[t for _, t, *_ in edge_rows()]]
    e = Encoder(make(queries.vocabulary_file(name)))
    for _ in range(2):
        got = [np.frombuffer(b, e.dtype).tolist() for b in e.encode(texts, 2)]
        assert got == [library_ids(make(queries.vocabulary_file(name)), t, 2) for t in texts]


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_packing(request, table):
    df = request.getfixturevalue(table)
    v = word_bpe(queries.vocabulary_file("word_bpe_49k.json"))
    got = [r.asDict() for r in packing.pack(df, v).collect()]
    full = Encoder(v).full
    left = Counter()
    for i, t in pairs(df):
        left[i, tuple(full.encode(t or "", add_special_tokens=False).ids + [packing.END])] += 1
    places = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in got)
    at = 0
    for place, n in places:  # gapless, and no piece crosses a window
        assert place == at and n > 0 and place // 2048 == (place + n - 1) // 2048
        at += n
    assert at == sum(len(k[1]) * n for k, n in left.items())
    got.sort(key=lambda r: r["sequence_id"] * 2048 + r["offset"])
    for r in got:
        if r["start"] == 0:
            same = [ids for (i, ids), n in left.items() if i == r["doc_id"] and n > 0 and len(ids) == r["doc_tokens"] and crc(ids[:r["length"]]) == r["ids_crc32"]]
            assert same
            current = same[0]
            left[r["doc_id"], current] -= 1
        assert crc(current[r["start"]:r["start"] + r["length"]]) == r["ids_crc32"]
    assert not +left


# --- 3

def brute_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, name in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")):
        h, _, p = name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(name) > len(best[0])):
            best = name, verdict
    low = re.sub("[A-Z]", lambda x: x[0].lower(), path)
    bad = re.search(r"/wp-login\.php|/cgi-bin/", low) or re.search(r"(^|[^0-9a-z])(casino|porn|viagra)([^0-9a-z]|$)", host + "\0" + low)
    return host, path, best[0] if best else None, best[1] if best else "block" if bad else "allow"


URLS = [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://net/", "http://xnet/a", "http://a.example.net/en/1?u=http://b.org/fr/", "http://a.example.net/en", "http://net?x/",
        "https://example.com/de/q#f", "https://EXAMPLE.com/DE/q", "ftp://x.example.org/fr/", "http://org/fr/x", "http://a.com/wp-login.php", "http://casino.com/", "http://a.com/x/Casino-1",
        "http://casinos.com/", "http://a.com/cgi-bin/x", "http://a.net:80/x", "http://u@a.net/x", "http://a.com/?porn", "http://a.com/\nnet/", "http://é.net/é", "x://y://z.net/", "http://a.com/" + "p/" * 20_000,
        "http://a.com/casino\u0130/x", "http://a.com/casino\u212a", "http://a.com/CASINO\u017f/y", "http://a.com/ca\u017fino"]


def test_url_rules(spark):
    rows = [(i, u, "h", "v", "t") for i, u in enumerate([*URLS, URLS[4], URLS[7]])] + [(None, "http://a.net/", None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, token string").repartition(3)
    got = [tuple(r) for r in url_rules.judge(df).collect()]
    assert canon(got) == canon((i, *brute_verdict(u)) for i, u, *_ in rows)
    assert url_rules.judge(df.limit(0)).count() == 0


def test_url_rules_open_end(spark):
    """No URL of the table has the token that the pattern ends in."""
    rows = [(1, "http://a.com/wp-login.php5"), (2, "http://a.com/x/WP-login.phps"), (3, "http://b.com/wp/login"), (4, "http://b.com/wp/login/2")]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert canon(tuple(r) for r in got) == canon((i, *brute_verdict(u)) for i, u in rows)


def test_url_rules_general(spark):
    """Rules without tokens, ties, and rules that end inside a token."""
    rules = (url_rules.host_rule("allow", "a.com/ab"), url_rules.host_rule("block", "b.com/ab"), url_rules.pattern_rule("block", "x{3}"))
    df = spark.createDataFrame([(1, "http://a.com/abc"), (2, "http://b.com/abc"), (3, "http://c.com/yxxxy")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(df, rules).collect()}
    assert got == {1: ("a.com/ab", "allow"), 2: ("b.com/ab", "block"), 3: (None, "block")}


# --- 4

def brute_fp(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in distinct}


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
@pytest.mark.parametrize("dense", [64, 1])
def test_simhash(request, table, dense):
    df = request.getfixturevalue(table)
    got = simhash.near_duplicates(df, dense=dense).collect()
    rows = [(i, brute_fp(t)) for i, t in pairs(df)]
    comp = brute_components([f for _, f in rows])
    least = {}
    for i, f in rows:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    assert canon((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == canon((i, f"{f:016x}", least.get(comp[f])) for i, f in rows)


@pytest.mark.parametrize("dense", [64, 3])
def test_simhash_links(spark, dense):
    """Fingerprints around a few centres, many of them in one table entry."""
    rng = np.random.default_rng(5)
    fps = {0, 1 << 63, (1 << 64) - 1}
    for c in rng.integers(0, 1 << 63, 5):
        for _ in range(60):
            f = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                f ^= 1 << int(b)
            fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    got = [(r["src"] % (1 << 64), r["dst"] % (1 << 64)) for r in simhash.links(df, dense).collect()]
    assert all(bin(a ^ b).count("1") <= 2 and a != b for a, b in got)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in got:
        root[find(a)] = find(b)
    want = brute_components(list(fps))
    assert len({(find(f), want[f]) for f in fps}) == len({find(f) for f in fps}) == len(set(want.values()))


@pytest.mark.parametrize("dense", [64, 1000])
def test_simhash_counts_links_at_every_size(spark, dense):
    """A cube of seven bits shares one upper segment; a few more differ from it above or stand alone."""
    fps = [*range(128), 127 ^ 1 << 40, 127 ^ 3 << 40, 1 << 50, 5 << 20, 5 << 20 | 1 << 45]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["fp"]: r["n_links"] for r in simhash.link_counts(*simhash.meetings(df, dense)).collect()}
    want = {f: sum(0 < bin(f ^ g).count("1") <= 2 for g in fps) for f in fps}
    assert got == {f: n for f, n in want.items() if n} and want[64] >= 28


def brute_representatives(rows):
    """(doc_id, text) that stay: of each component the smallest id, a null id last; rows that may stay, one list for each component."""
    comp = brute_components([brute_fp(t) for _, t in rows])
    groups = defaultdict(list)
    for i, t in rows:
        groups[comp[brute_fp(t)]].append((i, t))
    return [[(i, t) for i, t in g if i == min((j for j, _ in g if j is not None), default=None)] for g in groups.values()]


def assert_representatives(got, rows):
    want = brute_representatives(rows)
    assert len(got) == len(want) and all(sum(r in stays for r in got) >= 1 for stays in want)


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_representatives(request, table):
    df = request.getfixturevalue(table)
    got = simhash.representatives(df)
    assert got.columns == df.columns
    assert_representatives(pairs(got), pairs(df))


def test_representatives_null_and_repeated_ids(spark):
    a, b, c, d = ("alpha beta gamma delta", "one two three four", "red green blue grey", "north south east west")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (None, d), (9, c), (None, None), (7, ""), (3, "  ")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    got = pairs(simhash.representatives(df))
    assert_representatives(got, rows)
    assert canon(got) == canon([(None, a), (None, b), (7, c), (7, d), (3, "  ")])


# --- 5

def brute_budget(caps, weights, budget):
    """Water level by small steps of exact saturation."""
    out, live = {}, {c for c in caps if weights[c] > 0}
    budget = min(budget, sum(caps[c] for c in live))
    while live:
        level = budget / sum(weights[c] for c in live)
        full = [c for c in live if caps[c] <= level * weights[c] + 1e-9]
        if not full:
            out |= {c: level * weights[c] for c in live}
            break
        for c in full:
            out[c] = caps[c]
            budget -= caps[c]
            live.remove(c)
    return {c: out.get(c, 0.0) for c in caps}


@pytest.mark.parametrize("ratio", [0.3, 1.0, 5.0])
def test_budgets(spark, ratio):
    supply = {("a", "en", "s1"): 100, ("a", "en", "s2"): 1000, ("a", None, "s1"): 50, ("b", "en", "s1"): 10, ("b", "de", None): 20, ("c", "en", "s9"): 5000}
    weights = {("a",): 4.0, ("b",): 4.0, ("a", "en"): 3.0, ("c", "en", "s9"): 0.5, ("a", "en", "s2"): 0.0}
    t = mixing.Targets(weights=weights, ratio=ratio, max_epochs=2)
    df = spark.createDataFrame([(*k, v) for k, v in supply.items()], "domain string, lang string, source string, supply long")
    got = {(r["domain"], r["lang"], r["source"]): r["quota"] for r in mixing.budgets(df, t).collect()}
    level = {(): ratio * sum(supply.values())}
    for depth in (1, 2, 3):
        below = {}
        for p in level:
            caps = defaultdict(float)
            for k, v in supply.items():
                if k[:depth - 1] == p:
                    caps[k[:depth]] += 2 * v
            below |= brute_budget(caps, {c: weights.get(c, 1.0) for c in caps}, level[p])
        level = below
    assert all(abs(got[k] - level[k]) <= 1 for k in supply)


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_mix(request, table):
    df = request.getfixturevalue(table)
    got = [r.asDict() for r in mixing.mix(df, queries.TARGETS, queries.domain_of(F.col("source"))).collect()]
    tokens = {(i, t or ""): len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in pairs(df)}
    assert sum(r["n_tokens"] for r in got) <= sum(tokens.values())
    used = defaultdict(Counter)
    for r in got:
        leaf = r["domain"], r["lang"], r["source"], r["supply"], r["quota"]
        used[leaf][r["doc_id"], r["text_hash"]] += 1
    for (*_, supply, quota), seen in used.items():
        assert max(seen.values()) - min(seen.values()) <= 1 and max(seen.values()) <= 2
        total = sum(r["n_tokens"] for r in got if (r["doc_id"], r["text_hash"]) in seen)
        assert total <= quota
    if table == "docs":  # the prefix ends only where the next document does not fit
        largest = max(tokens.values())
        assert all(sum(r["n_tokens"] for r in got if (r["doc_id"], r["text_hash"]) in s) >= q - largest for (*_, q), s in used.items())


# --- 6

def brute_repeats(rows):
    where = defaultdict(set)
    bodies = [(t or "").encode() for _, t in rows]
    for d, b in enumerate(bodies):
        for p in range(len(b) - suffix.LENGTH + 1):
            where[b[p:p + suffix.LENGTH]].add((d, p))
    gone = [np.zeros(len(b), bool) for b in bodies]
    for places in where.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p:p + suffix.LENGTH] = True
    out = []
    for (i, _), b, g in zip(rows, bodies, gone):
        runs = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        out.append((i, len(b), int(g.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def suffix_rows():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé "), 5)) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words, n))

    base = [prose(300) for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(30):  # passages of all sizes around the limit, at all places
        src = base[k % 4]
        a, n = int(rng.integers(0, len(src) - 700)), int(rng.integers(330, 700))
        rows.append((100 + k, prose(int(rng.integers(0, 60))) + src[a:a + n] + prose(int(rng.integers(0, 60)))))
    near = list(base[0])
    for p in rng.integers(0, len(near), 3):
        near[p] = "#"
    rows += [(200, "".join(near)), (201, "a" * 1500), (202, "ab" * 300 + "a" * 450), (203, "b" * 399), (204, "b" * 400), (205, "\0" * 900), (206, base[1][:400]), (207, base[1][1:401] + "!")]
    same = prose(70)
    rows += [(300 + k, prose(40) + same + prose(30)) for k in range(12)]  # one passage in many documents
    return rows


def test_suffix(spark):
    rows = suffix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix.repeated_spans(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert canon(tuple(r) for r in got) == canon(brute_repeats(rows))


def test_suffix_edges(edge, empty):
    got = suffix.repeated_spans(edge).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert canon(tuple(r) for r in got) == canon(brute_repeats(pairs(edge)))
    assert suffix.repeated_spans(empty).count() == 0


def colliding_rows():
    """Texts whose bytes are the same in another order, so that they agree in sums of byte values, beside true copies of parts of them."""
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    left, right = ("".join(rng.choice(letters, n)) for n in (60, 300))
    mids = [list(rng.choice(letters, 200)) for _ in range(2)]
    rows = []
    for k, mid in enumerate(mids):
        for j in range(3):
            rng.shuffle(mid)
            rows.append((10 * k + j, left + "".join(mid) + right))
        rows += [(10 * k + 5, "x" * 50 + rows[-1][1] + "y"), (10 * k + 6, rows[-1][1][30:] + "z" * 90)]
    return rows


def test_suffix_bytes_decide(spark, monkeypatch):
    """With base 1 in both sums, texts collide at will; what is removed is still right."""
    monkeypatch.setattr(suffix, "BASE", 1)
    monkeypatch.setattr(suffix.Grams, "powers", np.ones(1, np.uint64))
    rows = colliding_rows() + suffix_rows()[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, compared = [], suffix.compared
    monkeypatch.setattr(suffix, "compared", lambda *a: seen.append(compared(*a)) or seen[-1])
    got = suffix.repeated_spans(df, base=1).collect()
    assert seen[0] is not None
    assert canon((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == canon(brute_repeats(rows))
    texts = {i: t for i, t in rows if [j for j, _ in rows].count(i) == 1 and t}
    for r in (r for r in got if r["doc_id"] in texts):
        body, at = texts[r["doc_id"]].encode(), 0
        kept = b""
        for s in r["spans"]:
            kept, at = kept + body[at:s["start"]], s["stop"]
        assert r["kept_text"] == (kept + body[at:]).decode("utf-8", "replace")


def test_hashes_modulo_a_prime():
    rng = np.random.default_rng(4)
    body = rng.integers(0, 256, 5000).astype(np.uint8)
    h = suffix.Check(body, 987654321)
    for a, b in ((0, 5000), (17, 417), (4600, 5000), (3, 3)):
        want = sum(int(h.values[x]) * pow(987654321, i, suffix.PRIME) for i, x in enumerate(body[a:b].tolist())) % suffix.PRIME
        assert int(h.of(np.array([a]), np.array([b]))[0]) == want


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    tokens = [rng.integers(0, 9, 5000), rng.integers(-4, 4, 5000), rng.integers(0, 1000, 5000)]
    order = suffix.multikey_quicksort(tokens, small=8)
    want = np.lexsort(tokens[::-1])
    assert all((t[order] == t[want]).all() for t in tokens)


# --- 7

def test_classifier(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = gam.classify(d, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_classifier_learns_one_row_of_each_id(spark, monkeypatch):
    seen, hot = [], next(i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2)
    monkeypatch.setattr(gam, "train", lambda x, y, s: seen.append(len(y)))
    df = spark.createDataFrame([(i if i < 20 else hot, f"some text number {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    gam.fit(df, labels)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(20))]


def test_classifier_edges(spark, edge, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(12)] + [(None, 1, 0), (3, None, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = gam.classify(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert gam.classify(empty, labels).count() == 0
    assert {r["score"] for r in gam.classify(edge, labels.limit(0)).collect()} == {0.5}
    scored = gam.with_score(edge, gam.fit(edge, labels))
    assert scored.columns == [c for c in edge.columns if c != "score"] + ["score"] and scored.count() == edge.count()


# --- 8

def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
@pytest.mark.parametrize("capacity", [8192, 4])
def test_exact(request, table, capacity):
    df = request.getfixturevalue(table)
    groups = defaultdict(list)
    for i, t in pairs(df):
        groups[lower(t)].append(i)
    want = []
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        want += [(i, top, len(ids), i == top, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = exact.deduplicate(df, capacity=capacity).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert canon(tuple(r) for r in got) == canon(want)
    kept = exact.kept_documents(df)
    assert kept.columns == df.columns and sorted(lower(t) for _, t in pairs(kept)) == sorted(groups)


def test_exact_texts_join_on_the_hash(spark):
    """Null ids meet by hash, not each with every shared hash of null ids."""
    df = spark.createDataFrame([(None, f"t {i // 2}") for i in range(200)], "doc_id long, text string")
    shared = exact.write_index(df).select("doc_id", "hash", F.lit("0/0").alias("bucket")).distinct()
    texts = exact.shared_texts(df, shared)
    join = re.findall(r"SortMergeJoin \[.*", texts._jdf.queryExecution().executedPlan().toString())[0]
    assert texts.count() == 200 and "hash" in join.split("]")[0]


def test_exact_hot_texts_are_dealt_to_many_owners(spark):
    """Two hot texts and one hash per bucket: no owner task has much more than its share, in one shuffle of the texts."""
    rows = [(i, ("Hot" if i % 3 else "hOT 2") if i < 2000 else f"t {i // 2}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.deduplicate(df, capacity=50).collect()}
    last = {lower(t): i for i, t in rows}
    size = Counter(lower(t) for _, t in rows)
    assert got == {i: (last[lower(t)], size[lower(t)]) for i, t in rows}
    entries = exact.write_index(df).groupBy("hash").count().withColumnRenamed("count", "n")
    depth, slots = exact.directory(entries, 50)
    owned = exact.owners(entries.filter("n < 100"), slots, depth, 200).collect()
    assert len(owned) == slots.count() and max(r["owner"] for r in owned) >= 8 and {r["pieces"] for r in owned} == {1}
    texts = df.select("doc_id", (F.col("doc_id") % 1).alias("owner"), (F.col("doc_id") % 1).alias("piece"), (F.col("doc_id") % 7).alias("salt"),
                      F.lit(True).alias("hot"), F.xxhash64("text").alias("hash"), F.col("text").alias("norm"))
    plan = exact.chained(texts, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("+- == Initial")[0].count("Exchange hashpartitioning") == 2
    assert {(r["keep_id"], r["group_size"]) for r in exact.chained(texts, 8).collect()} == {(last[lower(t)], size[lower(t)]) for _, t in rows}


def test_directory(spark):
    h = spark.range(5000).select(F.xxhash64("id").alias("hash"))
    depth, slots = exact.directory(h, 200)
    rows = h.withColumn("slot", exact.slot(depth)).join(slots, "slot")
    sizes = rows.groupBy("bucket").count().collect()
    assert rows.count() == 5000 and max(r["count"] for r in sizes) <= 200


# --- 10

@pytest.mark.parametrize("table", ["docs", "edge", "empty"])
def test_sharding(request, table):
    df = request.getfixturevalue(table)
    got = sharding.shard_documents(df).collect()
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs(df)]
    assert canon((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == canon(want)
    by = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1


def test_sharding_cuts_few_links(spark):
    rows = [(i, f"text {i % 40}" if i < 120 else f"own {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(df, shards=8).collect()
    shards = defaultdict(set)
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) - 1 for s in shards.values()) <= 4
    assert max(Counter(r["shard"] for r in got).values()) == 250


def test_sharding_of_a_group_larger_than_a_shard(spark):
    """A third of all rows are one text: it goes to few shards and fills most of them."""
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"own {i // 2}") for i in range(900)], "doc_id long, text string")
    got = sharding.shard_documents(df, shards=10).collect()
    assert set(Counter(r["shard"] for r in got).values()) == {90}
    hot = Counter(r["shard"] for r in got if r["doc_id"] % 3 == 0)
    assert len(hot) <= 5 and sorted(hot.values())[-2:] == [90, 90]


@pytest.mark.parametrize("group", [2, 3, 4, 8])
def test_sharding_where_all_rows_have_copies(spark, group):
    """Production parameters, neighbouring ids, no unlinked row: all groups fit whole."""
    df = spark.createDataFrame([(i, f"text {i // group}") for i in range(3200)], "doc_id long, text string")
    got = sharding.shard_documents(df).collect()
    shards = defaultdict(Counter)
    for r in got:
        shards[r["text_crc32"]][r["shard"]] += 1
    assert set(Counter(r["shard"] for r in got).values()) == {80}
    assert sum(group - max(c.values()) for c in shards.values()) <= 3200 // 20


# --- SQL and the pipeline

def stage_fixture(spark):
    """Whole sf0.001 documents with null and repeated ids, equal texts, repeated rows and columns with the names that stages use."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(None, "no id " + PASSAGE, "en", "s1", 1), (None, "another " + PASSAGE[::-1], "en", "s1", 1), (5, "same id, other text " + PASSAGE, "de", "src-3", 1),
            (9001, PASSAGE, "en", "src-4", 1), (9001, PASSAGE, "en", "src-4", 1), (9002, PASSAGE.upper(), "en", "src-4", 1), (9003, None, None, None, None), (9004, "", "en", None, 0)]
    more = spark.createDataFrame(rows, docs.schema)
    out = docs.union(more)
    for c in ("__id", "__n", "__hash", "__key", "__h", "__uses", "__h1", "__s1", "fp", "root", "score"):
        out = out.withColumn(c, F.lit("kept"))
    return out


def plain_score(model, text):
    """Row by row: one entry of each table, found by bisection."""
    x = gam.features(text)
    total = model.base + sum(t[bisect_right(e.tolist(), v)] for e, t, v in zip(model.edges, model.tables, x))
    coarse = [bisect_right(e.tolist(), v) for e, v in zip(model.pair_edges, x)]
    total += sum(t[coarse[i], coarse[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
    return 1 / (1 + math.exp(-min(max(total, -30), 30)))


def identity(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


@pytest.fixture(scope="module")
def staged(spark):
    """Input and output of each stage, one after the other."""
    out, docs = {}, stage_fixture(spark)
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        if name != "packing":
            assert result.columns == docs.columns
        result = materialize(result)
        out[name] = docs.collect(), result.collect()
        docs = result
    return out


def test_stage_classifier(spark, staged):
    given, kept = staged["quality classifier"]
    docs = stage_fixture(spark)
    model = gam.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {t: plain_score(model, t) for t in {r["text"] for r in given}}
    near = {t for t, s in scores.items() if abs(s - gam.CUT) < 1e-9}
    assert not near and identity(kept) == identity(r for r in given if scores[r["text"]] >= gam.CUT)


def test_stage_exact_dedup(staged):
    given, kept = staged["exact dedup"]
    best = {}
    for r in given:
        t = lower(r["text"])
        best[t] = max((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""), best.get(t, (False, -1, "")))
    assert Counter(lower(r["text"]) for r in kept) == Counter(dict.fromkeys(best, 1))
    assert all((r["doc_id"] is not None, r["doc_id"] or 0) == best[lower(r["text"])][:2] for r in kept)


def test_stage_near_dedup(staged):
    given, kept = staged["simhash near-dedup"]
    prints = [brute_fp(r["text"]) for r in given]
    root = brute_components(prints)
    parts = defaultdict(list)
    for fp, r in zip(prints, given):
        parts[root[fp]].append(r)
    want = Counter(min((r["doc_id"] is None, r["doc_id"] or 0) for r in part) for part in parts.values())
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == want
    assert not identity(kept) - identity(given)


def test_stage_mixing(spark, staged):
    given, mixed = staged["mixing"]
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in given], "doc_id long, text string, lang string, source string")
    uses = mixing.mix(frame, corpus_pipeline.TARGETS, corpus_pipeline.domain_of(F.col("source"))).collect()
    by_id = Counter(r["doc_id"] for r in uses)
    assert Counter(r["doc_id"] for r in mixed) == by_id
    assert not set(identity(mixed)) - set(identity(given)) and max(identity(mixed).values()) <= 2


def test_stage_packing(staged):
    given, pieces = staged["packing"]
    encoder = Encoder(word_bpe(corpus_pipeline.vocabulary_file("word_bpe_49k.json")))
    ids = [np.frombuffer(x, encoder.dtype).astype("<u4") for x in encoder.encode([r["text"] for r in given], 1)]
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    sums = Counter((r["doc_id"], len(x)) for r, x in zip(given, ids))
    assert Counter({k: v for k, v in Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0).items()}) == sums
    whole_pieces = Counter((p["doc_id"], p["ids_crc32"]) for p in pieces if p["length"] == p["doc_tokens"])
    assert not whole_pieces - Counter((r["doc_id"], zlib.crc32(x.tobytes())) for r, x in zip(given, ids))


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, SF)
    rows = got.collect()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(rows) > 100 and all(sum(n for _, n in v) <= 2048 for v in by.values())
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n


def test_stages_of_an_empty_table(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert canon(map(tuple, queries.QUERIES[name](spark, SF).select(*cols).collect())) == canon(cur.fetchall())
