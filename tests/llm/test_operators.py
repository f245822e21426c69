"""The operators against brute force, round trips and held-out accuracy, on small tables with the awkward cases in them."""

import base64
import bisect
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lipika.llm import decontamination, langid, licenses, lmscore, mixing, neardup, quality, rollup, sharding, warc
from lipika.llm.common import scratch_path, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def prose(rng: random.Random, n: int, letters: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus() -> list[tuple]:
    rng = random.Random(3)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(40)]
    texts = base + base[:5] + [b.replace(" ", " the ", 1) for b in base[5:10]] + [None, "", "   ", "!!!", "???", "!!!", "one two", "One, TWO", LONG, LONG + " end"]
    texts += [f"{base[11]}\nThis file is under the GNU General Public License version 3.\n{base[12]}", "CC-BY 4.0 and mit license, apache licence", "ab\u00e9" * 800 + " end"]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[40]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def odd(docs):
    """The same with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.concat(F.lit("keep"), F.col("doc_id")) for c in ("_words", "_id", "_source", "_size", "_copies", "_n", "_no", "_times", "_each", "_bad", "_gone", "_key", "gone_id", "gone_h", "text_h", "TEXT_H", "alone", "bad_id", "bad_h", "mix_id", "mix_h", "mix_n", "mix_no", "mix_each", "copies", "taken", "place", "block", "word", "c", "id", "h", "f0", "class_id", "held", "held_out", "letter", "count", "n", "target", "no", "tokenizer", "tokens", "documents", "kept", "text_crc32") if c != "TEXT_H"}).withColumns({c: F.lit("x") for c in ("size", "shard", "row", "key", "items", "label", "rank", "bucket", "file", "page")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df) -> dict:
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.doc_id, r)
    return out


# --- WARC -------------------------------------------------------------------------------------


def pages():
    rng = random.Random(1)
    html = [f"<p>{prose(rng, 50)}</p>é" for _ in range(30)]
    rows = [(i, f"http://h/{i}", html[i % 20]) for i in range(30)] + [(100, None, None), (101, "http://h/é\r\nX: y", ""), (102, "u", "x" * 300_000), (5, "http://h/5", html[5]), (None, "n", html[0]), (10**12, "far", html[1])]
    return rows


@pytest.mark.parametrize("min_bytes", [0, 500])
def test_warc_round_trip(spark, min_bytes):
    rows = pages()
    root = scratch_path(spark, "warc-test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(df, root, min_bytes, roll=20_000, target=5_000)
    got = warc.read_warc(spark, root).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    assert Counter((r.page_id, r.payload_digest) for r in got) == Counter((i, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in rows)
    keep: dict = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= min_bytes:
            keep[h or ""] = min(i, keep.get(h or "", i))
    html = {(i, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()): h or "" for i, _, h in rows}
    seen = set()
    for r in sorted(got, key=lambda r: (r.page_id is None, r.page_id or 0, r.record_type == "revisit")):
        h = html[r.page_id, r.payload_digest]
        first = h not in keep or (keep[h] == r.page_id and h not in seen)
        seen.add(h)
        assert r.record_type == ("response" if first else "revisit") and r.refers_to == (None if first else keep[h])
        assert r.payload_bytes == len(h.encode()) and (not first or r.payload.decode() == h)


def test_warc_revisits_name_their_response(spark):
    rows = [(1, "u1", "x" * 50), (1, "u1", "x" * 50), (1, "u0", "x" * 50), (2, None, "x" * 50), (None, "n", "x" * 50), (None, "n", "x" * 50), (3, "u3", "y"), (2**63 - 1, "m", "x" * 50)]
    root = scratch_path(spark, "warc-ids")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), root, target=1)
    files, base = warc.filesystem(root)
    heads = []
    for m in spark.read.parquet(f"{root}/_manifest").collect():
        for _, h, _ in warc.parse(files.open_input_stream(f"{base}/{m.file}", compression=None)):
            heads.append(h)
    assert len({h["WARC-Record-ID"] for h in heads}) == len(rows)
    response = {h["WARC-Record-ID"]: h for h in heads if h["WARC-Type"] == "response"}
    assert sorted(h["WARC-Target-URI"] for h in response.values()) == ["u0", "u3"]
    for h in heads:
        if h["WARC-Type"] == "revisit":
            to = response[h["WARC-Refers-To"]]
            assert (h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"], h["WARC-Payload-Digest"]) == (to["WARC-Target-URI"], to["WARC-Date"], to["WARC-Payload-Digest"])


def test_warc_ranges(spark):
    """Far more ranges than one look at the keys could give, hot ids and ids without number among them."""
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id) as k1", "xxhash64(id) as k2", "100L as bytes")
    bounds = warc._bounds(df, 1000)
    assert len(bounds[0]) == 2999 and (bounds[0] == 7).sum() > 900
    rows = df.collect()
    k1, k2 = np.array([r.k1 for r in rows]), np.array([r.k2 for r in rows])
    got = warc.range_of(k1, k2, bounds)
    keys = list(zip(*(b.tolist() for b in bounds), strict=True))
    assert got.tolist() == [bisect.bisect_left(keys, (a, b)) for a, b in zip(k1.tolist(), k2.tolist(), strict=True)]
    assert np.bincount(got).tolist() == [10] * 3000
    assert [len(b) for b in warc._bounds(df.limit(0), 1000)] == [0, 0]


def test_warc_files_are_the_same_again_and_gzip_reads_them(spark):
    import gzip

    sums = []
    for parts in (3, 7):
        root = scratch_path(spark, "warc-again")
        m = warc.write_warc(spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(parts), root, roll=20_000, target=5_000)
        sums.append(sorted((r.file, r.records, r["bytes"], r.sha256) for r in m.collect()))
        files, base = warc.filesystem(root)
        raw = b"".join(gzip.decompress(files.open_input_file(f"{base}/{f}").read()) for f, *_ in sums[-1])
        assert raw.count(b"WARC/1.1\r\n") == len(pages())
    assert sums[0] == sums[1] and len(sums[0]) > 2
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- mixing -----------------------------------------------------------------------------------


def exact_targets(sizes):
    """Shares by weight 1, 2, 3; what is over three times a source's size is shared again."""
    out, left, n = [None] * len(sizes), Fraction(sum(sizes)), len(sizes)
    while open_ := [i for i in range(n) if out[i] is None]:
        unit = left / sum(1 + i % 3 for i in open_)
        over = [i for i in open_ if unit * (1 + i % 3) > 3 * sizes[i]]
        for i in over or open_:
            out[i] = Fraction(3 * sizes[i]) if over else unit * (1 + i % 3)
        left -= sum(out[i] for i in over)
        if not over:
            break
    return out


def test_targets(spark):
    assert exact_targets([1000, 10, 10]) == [1020 - 60, 30, 30]
    rng = random.Random(5)
    cases = [[100, 100, 100], [1000, 10, 10], [0, 50], [0, 0], [7], [10**15, 10**14 + 1, 3], [rng.randint(0, 1000) for _ in range(40)], [10 ** rng.randint(0, 6) for _ in range(25)]]
    for sizes in cases:
        names = sorted([f"s{i}" for i in range(len(sizes) - 1)], key=str.encode) + [None]
        units = spark.createDataFrame([(s, z, 1) for s, z in zip(names, sizes, strict=True)], "source string, size long, n long")
        got = {r.source: r for r in mixing.source_plan(units).collect()}
        for k, (name, size, want) in enumerate(zip(names, sizes, exact_targets(sizes), strict=True)):
            r = got[name]
            assert (r.source_no, r.source_size) == (k, size) and r.target == pytest.approx(float(want), rel=1e-15)
            assert r.whole + r.part == pytest.approx(float(want / size) if size else 0) and 0 <= r.part < 1 and r.whole <= 3


def test_flight_balances():
    rng = np.random.default_rng(0)
    size = rng.integers(0, 5000, 4000)
    p = rng.random(4000)
    out = mixing.flight(p, size, rng, True)
    assert set(out) <= {0.0, 1.0} and abs((out - p) @ size) < 5 and abs((out - p).sum()) < 12
    # inclusion probabilities hold on average
    mean = np.mean([mixing.flight(np.full(600, 0.3), size[:600], np.random.default_rng(i), True) for i in range(60)], axis=0)
    assert abs(mean.mean() - 0.3) < 0.01 and abs(mean[:300].mean() - 0.3) < 0.03


def test_mix(spark, docs, odd):
    rows = mixing.mix(docs).collect()
    data = corpus()
    words = lambda t: len(SPACE.findall(t or ""))
    total = Counter()
    for _, t, _, s, _ in data:
        total[s] += words(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, exact_targets([total[s] for s in order]), strict=True))
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, words(t)) for i, t, *_ in data)
    assert all(r.taken <= 3 * r["size"] and r.source_size == total[r.source] and abs(r.target - float(want[r.source])) < 1e-6 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(5)).collect()))
    mixed = mixing.mixed_documents(odd)
    got = mixed.collect()
    assert mixed.columns == odd.columns and len(got) == sum(r.copies for r in rows) and all(r._words == r.mix_n == f"keep{r.doc_id}" for r in got)
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, prose(rng, rng.randint(1, 60)), "en", "abc"[min(2, i % 7)], 0) for i in range(600)], DOCS)
    by = {}
    for r in mixing.mix(df).collect():
        t = by.setdefault(r.source, [r.target, 0])
        t[1] += r.taken
    assert all(abs(got - want) < 0.01 * want for want, got in by.values())


# --- decontamination --------------------------------------------------------------------------


def brute_contamination(docs, items, window=10):
    windows: dict = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t, *_ in docs:
        w, hit, found = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [1, 4])
def test_contamination(spark, docs, odd, monkeypatch, blocks):
    data = corpus()
    items = [(1, data[0][1]), (2, " ".join(data[1][1].split()[5:17]).upper()), (3, "one two"), (10, "ONE-two"), (4, None), (5, ""), (6, "no such phrase here"), (None, data[2][1]), (1, data[3][1]), (7, LONG)]
    if blocks > 1:
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", 90_000)
        monkeypatch.setattr(decontamination, "PIECE_WORDS", 700)
        monkeypatch.setattr(decontamination, "FOLLOW", 100)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(data, items)
    for d in (docs, odd):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(d, bench).collect()), key=str)
        assert got == want
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(empty(spark), bench).count() == 0


def test_proximity(spark, docs):
    index = decontamination.build_index(docs)
    data = corpus()
    for terms in (["one", "two"], data[0][1].split()[3:6:2], ["w1x1", "w3x3", "w2x2"]):
        span = 6
        want = set()
        for i, t, *_ in data:
            w = ALNUM.findall((t or "").translate(LOWER))
            want |= {(i, s) for s in range(len(w)) if w[s] in terms and set(terms) <= set(w[s : s + span])}
        got = {(r.doc_id, r.position) for r in decontamination.search_near(index, terms, span).collect()}
        assert got == want


# --- near duplicates --------------------------------------------------------------------------


def shingle_counts(t):
    w = ALNUM.findall(t.translate(LOWER))
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter({("raw", t): 1})


def brute_jp(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def brute_classes(rows, threshold=0.8):
    number: dict = {}
    sets = {i: Counter({number.setdefault(k, len(number)): v for k, v in shingle_counts(t).items()}) for i, t, *_ in rows if t is not None}
    arrays = {i: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for i, c in sets.items()}
    root = {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a].keys() & sets[b].keys())
        if common:
            s = common / len(sets[a].keys() | sets[b].keys())
            if max(*sets[a].values(), *sets[b].values()) > 1:  # else the two measures are equal
                s = max(s, neardup.probability_jaccard(*arrays[a], *arrays[b]))
            if s >= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in root}


def test_probability_jaccard():
    rng = random.Random(2)
    for _ in range(30):
        a = Counter({i: rng.randint(1, 5) for i in rng.sample(range(40), 20)})
        b = Counter({i: rng.randint(1, 5) for i in rng.sample(range(40), 25)})
        arrays = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for c in (a, b)]
        assert neardup.probability_jaccard(*arrays[0], *arrays[1]) == pytest.approx(brute_jp(a, b))


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(4)
    m = 4096
    items = rng.integers(1, 2**48, 60).astype(np.uint64)
    a, wa = np.sort(items[:45]), rng.integers(1, 6, 45)
    b, wb = np.sort(items[15:]), rng.integers(1, 6, 45)
    sig = neardup.prob_minhash(np.repeat([0, 1], 45), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, m)
    want = neardup.probability_jaccard(a, wa, b, wb)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / m)


def test_near_duplicates(spark, docs, odd):
    want = brute_classes(corpus())
    for d in (docs, odd):
        got = neardup.near_duplicates(d).collect()
        assert len(got) == len(corpus()) and {r.doc_id: r.class_id for r in got} == want
    kept = neardup.representatives(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_null_and_very_large_ids(spark):
    rng = random.Random(14)
    a, big = prose(rng, 80), 2**60 + 1
    rows = [(None, a, "en", "s", 1), (None, None, None, None, None), (big, a, "en", "s", 1), (big + 2, prose(rng, 60), None, None, None), (None, prose(rng, 70), "de", None, 3), (5, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    ids = Counter(r[0] for r in rows)
    for out in (mixing.mix(df), neardup.near_duplicates(df), decontamination.contamination(df, bench), langid.identify(df), licenses.scan(df), quality.quality(df), sharding.shard_documents(df), lmscore.score_documents(df)):
        assert Counter(r.doc_id for r in out.collect()) == ids
    kept = [(r.doc_id, r.text) for r in neardup.representatives(df).collect()]
    assert Counter(kept) == Counter((r[0], r[1]) for r in rows if (r[0], r[1]) != (None, a))
    # row by row: only texts that are hit go
    clean = decontamination.clean_documents(df, bench)
    assert clean.columns == df.columns and Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((r[0], r[1]) for r in rows if r[1] != a)
    assert set(r.doc_id for r in mixing.mixed_documents(df).collect()) <= set(ids)


def test_one_doc_id_with_several_texts(spark):
    rng = random.Random(15)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, a, "en", "s", 0), (3, b, "en", "s", 0), (3, b, "en", "s", 0), (1, b, "en", "s", 0), (4, c, "en", "s", 0), (None, c, "en", "s", 0), (None, a.upper(), "en", "s", 0), (6, None, "en", "s", 0), (6, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = neardup.near_duplicates(df)
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == Counter([(1, 1)] * 3 + [(2, 1), (3, 1), (3, 1), (4, 4), (None, 4), (None, 1), (6, 6), (6, 6)])
    assert Counter((r.doc_id, r.text) for r in neardup.representatives(df).collect()) == Counter([(1, a), (1, b), (4, c), (6, None)])


def test_chains_and_dense_groups(spark):
    """A large group whose members are near the threshold of each other."""
    rng = random.Random(11)
    base = prose(rng, 120).split()
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_classes(rows)


def brute_links(rows, threshold=0.8):
    """Classes by all pairs, with both measures of each."""
    sets = {i: shingle_counts(t) for i, t, *_ in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x.keys() & y.keys() and max(len(x.keys() & y.keys()) / len(x.keys() | y.keys()), brute_jp(x, y)) >= threshold:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_texts_that_differ_by_a_repeated_passage(spark):
    """Alike by plain Jaccard only: weighted registers hardly ever share a band."""
    rng = random.Random(21)
    rows = []
    for i in range(12):
        w = prose(rng, 300).split()
        rows += [(2 * i, " ".join(w), "en", "s", 0), (2 * i + 1, " ".join(w[:64] * 20 + w[64:]), "en", "s", 0)]
    assert all(brute_jp(shingle_counts(rows[i][1]), shingle_counts(rows[i + 1][1])) < 0.6 for i in range(0, 24, 2))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_links(rows) == {i: i - i % 2 for i in range(24)}


def test_texts_that_share_a_heavily_repeated_passage(spark):
    """Alike by probability Jaccard only: plain Jaccard is low."""
    rng = random.Random(22)
    rows = []
    for i in range(6):
        block = prose(rng, 40)
        rows += [(2 * i + k, " ".join([*[block] * 50, prose(rng, 80)]), "en", "s", 0) for k in range(2)]
    for i in range(0, 12, 2):
        x, y = shingle_counts(rows[i][1]), shingle_counts(rows[i + 1][1])
        assert len(x.keys() & y.keys()) / len(x.keys() | y.keys()) < 0.3 and brute_jp(x, y) > 0.9
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_links(rows) == {i: i - i % 2 for i in range(12)}


def test_open_buckets_compare_repeated_passages():
    """Of both kinds of pairs, the exact comparison of open buckets gives the larger measure."""
    rng = random.Random(23)
    w, block = prose(rng, 300).split(), prose(rng, 40)
    for a, b in ((" ".join(w), " ".join(w[:64] * 20 + w[64:])), tuple(" ".join([*[block] * 50, prose(rng, 80)]) for _ in range(2))):
        data = np.frombuffer((a + b).encode(), np.uint8)
        row, item, weight, _, _ = neardup.weighted_shingles(data, np.array([0, len(a), len(a) + len(b)]))
        t = pa.table({"small": [(item[row == k] >> np.uint64(16)).astype(np.uint32).tobytes() for k in (0, 1)], "heavy": [weight[row == k].astype(np.int32).tobytes() for k in (0, 1)]})
        x, y = shingle_counts(a), shingle_counts(b)
        want = max(len(x.keys() & y.keys()) / len(x.keys() | y.keys()), brute_jp(x, y))
        assert neardup._Sets(t).similarities(0, np.array([1])).tolist() == pytest.approx([want])


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 10), (4, 5), (20, 21), (21, 22), (22, 20)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 201 + i) for i in range(20)]
    got = {r.id: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[5] == 1 and got[10] == 9 and got[22] == 20 and got[129] == 100 and got[220] == 200


# --- language ---------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(6)
    alphabets = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "opqrstué"}
    rows = [(i, prose(rng, 12, a), lang, "s", 0) for i in range(600) for lang, a in [list(alphabets.items())[i % 3]]]
    rows += [(1000, None, "aa", "s", 0), (1001, "123 !!", "aa", "s", 0), (1002, prose(rng, 9, "abcd"), None, "s", 0), (None, prose(rng, 9, "opqr"), "cc", "s", 0), (7, rows[7][1], rows[7][2], "s", 0), (1003, "abcd efgh " * 50_000, "aa", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = langid.identify(df).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in held) / len(held) > 0.97
    one = by_id(df.sparkSession.createDataFrame(got))
    assert one[1000].lang_pred == one[1001].lang_pred == "und" and one[1002].lang_pred == "aa" and one[None].lang_pred == "cc" and not one[None].held_out
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df["lang"].substr(9, 1)).where("lang is null")).collect()} <= {"und"}
    assert langid.identify(empty(spark)).count() == 0


def test_language_does_not_use_the_held_out(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 12, "abcdef" if i % 2 else "ghijkl"), "xx" if i % 2 else "yy", "s", 0) for i in range(200)]
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s, n) for i, t, lang, s, n in rows]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(x, DOCS)).collect()) for x in (rows, other))
    assert a == b


def brute_grams(text):
    """Slots of all grams of 1 to 4 characters, in whole numbers of 32 bits."""
    chars = [32 if 9 <= ord(x) <= 13 else ord(x) for x in text.lower()]
    out = Counter()
    for i in range(len(chars)):
        h = 0
        for x in chars[i : i + 4]:
            h = (h * 0x01000193 + x + 1) % 2**32
            g = h * 0x9E3779B1 % 2**32
            out[(g ^ (g >> 15)) % 2**18] += 1
    return out


def test_gram_counts(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "ÀÉß Σ\n\tİx", "नमस्ते दुनिया", "你好世界。", "", "𝒳y" * 9, prose(rng, 40), prose(rng, 300, "αβγδεж中文字"), "x" * 1001]
    for step in (langid.STEP, 64):
        monkeypatch.setattr(langid, "STEP", step)
        got = list(langid.counts(texts))
        assert [dict(zip(at.tolist(), n.tolist(), strict=True)) for at, n in got] == [brute_grams(t) for t in texts]
        assert all((np.diff(at) > 0).all() for at, _ in got)


def test_predictions_against_brute_force(spark):
    rng = random.Random(16)
    words = {"te": "తెలుగు భాష లో మాట పుస్తకం నది ఇల్లు".split(), "hi": "हिन्दी भाषा में शब्द किताब नदी घर".split(), "zh": list("中文语言里的词书河家"), "mr": "मराठी भाषेत शब्द पुस्तक नदी घर आहे".split(), "el": "ΓΛΏΣΣΑ και λέξη βιβλίο ποτάμι σπίτι".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(12)), lang, "s", 0) for i in range(400) for lang in [list(words)[i % 5]]] + [(900, "१२३ !", None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    training = df.where("lang is not null").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    langs, idf, w, t = langid.fit(training)
    assert langs == sorted(words) and len(idf) == langid.DIM
    learned = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 5]
    df_count = Counter(g for r in learned for g in brute_grams(r[1]))
    for r in langid.identify(df).collect():
        text, lang = next((x[1], x[2]) for x in rows if x[0] == r.doc_id)
        if lang is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        tf = {g: (1 + math.log(n)) * (math.log((1 + len(learned)) / (1 + df_count[g])) + 1) for g, n in brute_grams(text).items()}
        norm = math.sqrt(sum(x * x for x in tf.values()))
        z = [sum(x / norm * w[g, k] for g, x in tf.items()) / t for k in range(len(langs))]
        p = [math.exp(x - max(z)) / sum(math.exp(y - max(z)) for y in z) for x in z]
        assert r.score == pytest.approx(max(p)) and r.lang_pred == langs[p.index(max(p))]
        assert r.lang_pred == lang


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, 2 + int(rng.integers(50))]), np.array([0.9, 0.3]), y) for y in rng.integers(0, 2, 300)]
    w = langid.ftrl(rows, 2)
    assert (w[100:] == 0).all() and w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]


# --- token counts -----------------------------------------------------------------------------


def test_rollup(spark, docs, tmp_path):
    data = corpus()
    want = Counter()
    for _, t, lang, s, _ in data:
        want[s, lang, "d"] += 1
        want[s, lang, "t"] += len(SPACE.findall(t or ""))
    words = rollup.token_rollup(docs, None).collect()
    assert len(words) == len({k[:2] for k in want})
    assert {(r.source, r.lang): (r.documents, r.tokens) for r in words} == {k[:2]: (want[(*k[:2], "d")], want[(*k[:2], "t")]) for k in want if k[2] == "d"}
    assert rollup.token_rollup(empty(spark), None).count() == 0


def test_rollup_deltas(spark, docs, tmp_path):
    roll = rollup.Rollup(spark, f"file://{tmp_path}/r")
    counted = rollup.count_tokens(docs, None)
    assert roll.commit("load", rollup.inserts(counted)) and not roll.commit("load", rollup.inserts(counted))
    total = lambda: tuple(roll.totals().selectExpr("sum(documents)", "sum(tokens)").first())
    n, t = total()
    part = counted.where("doc_id < 10")
    roll.commit("gone", rollup.deletes(part))
    gone = part.selectExpr("count(*)", "sum(tokens)").first()
    assert total() == (n - gone[0], t - gone[1])
    roll.commit("back", rollup.inserts(part))
    roll.commit("again", rollup.revisions(part, part.withColumn("tokens", part["tokens"] + 1).withColumn("lang", part["source"])))
    assert total() == (n, t + gone[0])
    before = sorted(map(tuple, roll.totals().collect()), key=str)
    assert roll.compact()
    assert sorted(map(tuple, roll.totals().collect()), key=str) == before and not roll.commit("load", rollup.inserts(counted))
    with pytest.raises(ValueError):
        roll.commit("../x", rollup.inserts(counted))


def test_rollup_steps_that_stop_or_race(spark, docs, tmp_path, monkeypatch):
    roll = rollup.Rollup(spark, f"file://{tmp_path}/s")
    counted = rollup.count_tokens(docs, None)
    totals = lambda r: sorted(map(tuple, r.totals().collect()), key=str)
    first, other = rollup.inserts(counted.where("doc_id < 20")), rollup.inserts(counted.where("doc_id >= 20"))
    # two that both saw a free name: the second one's changes are refused
    with monkeypatch.context() as m:
        m.setattr(rollup.Rollup, "committed", lambda self, batch: False)
        real, m_fs = roll._fs, roll._fs
        assert roll.commit("a", first)
        create = roll._create
        m.setattr(rollup.Rollup, "_create", lambda self, path, content: create(path, content))
        m.setattr(roll, "_fs", _NeverThere(real))
        assert not roll.commit("a", other)
        m.setattr(roll, "_fs", m_fs)
    want = totals(roll)
    assert sum(r[3] for r in want) == 20 + 1  # doc 3 is there twice
    # stopped after the data was written, before the marker; and while the marker was written
    with monkeypatch.context() as m:
        m.setattr(rollup.Rollup, "_create", lambda self, path, content: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            roll.commit("b", other)
        with pytest.raises(RuntimeError):
            roll.compact()
    roll._fs.create(roll._path(f"{roll.root}/batches/b"), False).close()
    roll._fs.create(roll._path(f"{roll.root}/compactions/00000000"), False).close()
    assert totals(roll) == want and roll.batches() == ["a"]
    assert roll.commit("b", other) and not roll.commit("b", other)
    want = totals(roll)
    assert roll.compact() and totals(roll) == want and roll.batches() == ["a", "b"] and not roll.commit("a", first)
    # two compactions from one state: one counts
    state = roll._state()
    assert roll.commit("c", rollup.deletes(counted.where("doc_id >= 20")))
    assert roll.compact()
    with monkeypatch.context() as m:
        m.setattr(rollup.Rollup, "_state", lambda self: state)
        assert not roll.compact()
    gone = totals(roll)
    assert sum(r[3] for r in gone) == 21
    roll.vacuum()
    assert totals(rollup.Rollup(spark, roll.root)) == gone and len(roll._names("data")) == 1


class _NeverThere:
    """A file system on which every name looks free until it is created."""

    def __init__(self, fs):
        self.fs = fs

    def exists(self, path):
        return False

    def __getattr__(self, name):
        return getattr(self.fs, name)


def test_bpe_counts(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("t", pat_str=rollup.BPE_PATTERN, mergeable_ranks=rollup.load_ranks(), special_tokens={})
    got = {r.doc_id: r.tokens for r in rollup.count_tokens(docs).where("tokenizer like 'byte%'").collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t, *_ in corpus()}


# --- quality ----------------------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w, seen, dup = SPACE.findall(t), set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def brute_content(t, model):
    """Content share, content lines and lines with words, by a Viterbi walk over the features of one text at a time."""
    w, trans = model
    raw = (t or "").encode()
    data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    x, _ = quality.line_features(data, quality.Lines(data, off), word_hashes(data, off, "space")[0])
    path, best = [], None
    for row in x.astype(float) @ w:
        if best is None:
            best = list(row)
        else:
            back = [max((0, 1), key=lambda u: best[u] + trans[u, v]) for v in (0, 1)]
            best = [best[back[v]] + trans[back[v], v] + row[v] for v in (0, 1)]
            path.append(back)
    y = [int(best[1] > best[0])]
    for back in reversed(path):
        y.append(back[y[-1]])
    y = y[::-1]
    n = [len(SPACE.findall(line)) for line in (t or "").split("\n")]
    return sum(a * b for a, b in zip(n, y, strict=True)) / max(1, sum(n)), sum(a > 0 and b for a, b in zip(n, y, strict=True)), sum(a > 0 for a in n)


def quality_rows():
    rng = random.Random(12)
    rows = [(i, ". ".join(prose(rng, 30).capitalize() for _ in range(4)) + ".", "en", "s", 0) for i in range(40)]
    rows += [(100, "\n".join("| " + " | ".join(prose(rng, 8).split()) + " |" for _ in range(20)), "en", "s", 0), (101, "é é é\né é é\n\n x \n\tx\né é é", "en", "s", 0), (102, "a\x00b c d # < >\r\n" * 40, "en", "s", 0), (103, "\n".join("| " + " | ".join(prose(rng, 8).split()) + " |" for _ in range(20)), "en", "s", 0)]
    return rows + [(200 + i, t, lang, s, n) for i, (_, t, lang, s, n) in enumerate(corpus())]


def test_quality(spark):
    rows = quality_rows()
    got = by_id(quality.quality(spark.createDataFrame(rows, DOCS)))
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), i
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(40))
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 2)] + [(100, 0), (103, 0), (7, None), (None, 0), (0, 0), (99_999, 0)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    verdict = {r.doc_id: r for r in quality.quality(df, labels).collect()}
    for i, t, *_ in rows:
        share, content, lines = brute_content(t, model)
        r = verdict[i]
        assert (r.content_share, r.n_content_lines, r.n_lines) == (pytest.approx(share), content, lines) and r.kept == (not r.base_failed and share >= 0.5)
    assert all(verdict[i].kept for i in range(40)) and not verdict[100].kept and not verdict[103].kept
    odd = df.withColumn("kept", df["doc_id"]).withColumn("good", df["doc_id"]).select("kept", "text", "good", *(c for c in df.columns if c != "text"))
    kept = quality.kept_documents(odd, labels)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.quality(df, labels).where("kept").collect())
    assert quality.quality(empty(spark)).count() == 0


def test_viterbi_and_gradient_against_brute_force():
    rng = np.random.default_rng(3)
    x = rng.random((11, len(quality.FEATURES))) < 0.4
    start = np.array([0, 4, 4, 5, 11])
    w, trans = rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2))
    got = quality.viterbi(x, start, w, trans)
    for a, b in itertools.pairwise(start):
        if a == b:
            continue
        s = x[a:b].astype(float) @ w
        best = max(itertools.product((0, 1), repeat=b - a), key=lambda y: sum(s[i, v] for i, v in enumerate(y)) + sum(trans[u, v] for u, v in itertools.pairwise(y)))
        assert got[a:b].tolist() == list(best)
    y = (x[:, 3] ^ x[:, 7]).astype(int)
    w, trans = quality.train(x, y, start, steps=300)
    assert (quality.viterbi(x, start, w, trans) == y).mean() > 0.9


# --- sharding ---------------------------------------------------------------------------------


def brute_capacity(sizes, n):
    ends = [0, *np.cumsum(sizes).tolist()]
    best = [0] + [math.inf] * len(sizes)
    for _ in range(n):
        best = [0] + [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(1, len(sizes) + 1)]
    return best[-1]


def test_smallest_capacity():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 25))]
        ends = np.cumsum(sizes)
        floor = lambda x: int(max([0, *ends[ends <= x]]))  # noqa: B023, E731
        n = rng.randint(1, 8)
        capacity, cuts = sharding.smallest_capacity(int(ends[-1]), max(sizes), n, floor)
        assert capacity == brute_capacity(sizes, n) and cuts[-1] == ends[-1] and max(np.diff([0, *cuts])) <= capacity


def test_shards(spark, docs, odd, monkeypatch):
    data = corpus()
    for d, block in ((docs, 65_536), (odd, 4)):
        monkeypatch.setattr(sharding, "BLOCK", block)
        got = sharding.shard_documents(d).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in data)
        for s in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        where: dict = {}
        text = {i: t for i, t, *_ in data}
        for r in got:
            where.setdefault(text[r.doc_id], set()).add(r.shard)
        assert all(len(x) == 1 for x in where.values())
        # the order of groups is that of their keys
        groups = Counter()
        for _, t, *_ in data:
            groups["" if t is None else hashlib.sha256(t.encode()).hexdigest()[:32]] += len((t or "").encode()) + 1
        loads = Counter()
        for r in got:
            loads[r.shard] += r["size"]
        assert max(loads.values()) == brute_capacity([groups[k] for k in sorted(groups)], 8)
    assert sharding.shard_documents(empty(spark)).count() == 0


# --- licenses ---------------------------------------------------------------------------------


def brute_licenses(t):
    words = ALNUM.findall((t or "").translate(LOWER))
    text = " " + " ".join(words) + " "
    found = []
    for r in licenses.rules():
        if r["keyword"] in text:
            for m in re.finditer(r["pattern"], text):
                first = text[: m.start()].count(" ") - 1
                found.append((first, first + m[0].count(" ") + 1, r["priority"], r["no"], r["label"], r["base"], r["confidence"]))
    kept = [d for d in found if not any(o is not d and o[2] >= d[2] and o[0] <= d[0] and o[1] >= d[1] and ((o[1] - o[0], o[2], -o[3]) > (d[1] - d[0], d[2], -d[3])) for o in found)]
    base = [d for d in found if d[5]]
    labels = sorted({d[4] for d in kept + base})
    return len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), ",".join(sorted({d[4] for d in base})), ",".join(labels)


LICENSED = [
    "Licensed under the Apache License, Version 2.0 (the License)",
    "This work is licensed under the GNU General Public License, version 3. All rights reserved. MIT License; mit LICENSE mit license",
    "SPDX-License-Identifier: MIT and CC-BY-NC-SA 4.0, CC BY",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Released under the GNU Lesser General Public License version 2.1 or the Mozilla Public License 2.0",
    "http://creativecommons.org/licenses/by-sa/4.0 É CC BY cc by",
    "permit license, remit license, cc byte, gnu general public licenses, apachelicense",
    "MIT license " * 3000,
]


def test_licenses(spark, docs, odd):
    rows = corpus() + [(500 + i, t, "en", "s", 0) for i, t in enumerate(LICENSED)]
    got = by_id(licenses.scan(spark.createDataFrame(rows, DOCS)))
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute_licenses(t), (i, t and t[:80])
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    assert got[500].labels == "apache,apache-2.0" and "gpl-3.0" in got[501].labels and got[502].labels.startswith("cc-by")
    assert licenses.scan(odd).count() == len(corpus()) and licenses.scan(empty(spark)).count() == 0


def fewest(parsed):
    """What a parsed expression can match, with every alternative and every choice of one or none taken."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(v) for o, v in arg if str(o) == "LITERAL"] or ["1"]
        elif name == "MAX_REPEAT":
            inner = fewest(arg[2])
            more = [*([""] if arg[0] == 0 else []), *inner]
        elif name == "SUBPATTERN":
            more = fewest(arg[3])
        elif name == "BRANCH":
            more = [x for b in arg[1] for x in fewest(b)]
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
            more = [""]
        out = [a + b for a in out for b in dict.fromkeys(more)]
    return out


def test_license_keywords_are_in_every_match():
    for r in licenses.rules():
        lacking = [x for x in fewest(re._parser.parse(r["pattern"])) if r["keyword"] not in x]
        assert not lacking, (r["keyword"], lacking[:3])


def test_license_names_without_their_usual_word(spark, monkeypatch):
    """Against brute force that tries every rule on every text."""
    want = {
        "Released under the Expat License": "mit", "X11 license": "mit", "PSF licence agreement": "python-2.0", "Open RAIL (M) License": "openrail", "2-clause license": "bsd-2-clause",
        "BSD 2-clause license": "bsd-2-clause", "2-clause BSD license": "bsd-2-clause", "FreeBSD 2 clause license": "bsd-2-clause", "terms of the trail": "",
        "either version 2 of the License, or (at your option) any later version": "gpl-2.0",
    }
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*want, *LICENSED[:-1]])]
    got, every = by_id(licenses.scan(spark.createDataFrame(rows, DOCS))), licenses.rules()
    monkeypatch.setattr(licenses, "rules", lambda: [r | {"keyword": ""} for r in every])
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute_licenses(t), t
        assert r.labels == want.get(t, r.labels) and (r.score > 0) == (r.labels != "")


def test_license_rules():
    rules = licenses.rules()
    assert len(rules) >= 200 and len({r["no"] for r in rules}) == len(rules)
    for r in rules:
        re.compile(r["pattern"])


# --- LM scoring -------------------------------------------------------------------------------


def all_segmentations(word, pieces):
    if not word:
        return 1.0
    return sum(math.exp(pieces[word[:k]]) * all_segmentations(word[k:], pieces) for k in range(1, len(word) + 1) if word[:k] in pieces)


def test_lattice_sums_all_segmentations():
    pieces = lmscore.normalise([(b"ab", 1), (b"abc", 2), (b"bc", 3), (b"c", 9), ("é".encode(), 4)], 300)
    table = lmscore.prefix_table(pieces)
    for word in (b"a", b"abcabc", b"xyz", "éa".encode(), b"abcbcbca"):
        assert lmscore.log_marginal(word, table) == pytest.approx(math.log(all_segmentations(word, pieces)))
    # expected counts: of every byte, one piece holds it
    got = lmscore.expected_counts(iter([(b"abcabc", 3), (b"xyz", 2)]), table)
    assert sum(len(k) * v for k, v in got.items()) == pytest.approx(6 * 3 + 3 * 2)
    assert sum(map(math.exp, lmscore.reweigh(pieces, got).values())) == pytest.approx(1)
    assert math.isfinite(lmscore.log_marginal(b"q" * 5000, table)) and lmscore.expected_counts(iter([(b"\xff" * 500, 1)]), table)


def test_lm_scores(spark, docs, odd):
    pytest.importorskip("sentencepiece")
    data = corpus()
    toks = [[*SPACE.findall((t or "").translate(LOWER)), None] for _, t, *_ in data]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in data]
    c = Counter(w for ws, h in zip(toks, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    # the vocabulary's weights after the training words' expected counts, and each word by all its segmentations
    pieces = lmscore.load_pieces()
    whole = lambda w: lmscore.START + w.encode()
    pieces = lmscore.reweigh(pieces, lmscore.expected_counts(((whole(w), k) for w, k in sorted(c.items(), key=str) if w is not None), lmscore.prefix_table(pieces)))
    table = lmscore.prefix_table(pieces)
    logp = {w: lmscore.log_marginal(whole(w), table) / math.log(10) for ws in toks for w in ws if w is not None}
    short = next(w for w in c if w is not None and len(w) < 9)
    assert logp[short] == pytest.approx(math.log10(all_segmentations(whole(short), pieces)))
    end = (c[None] + 1) / (n + 2)
    for d in (docs, odd):
        got = sorted(lmscore.score_documents(d).collect(), key=lambda r: r.doc_id)
        want = sorted(zip([x[0] for x in data], held, toks, strict=True), key=lambda x: x[0])
        assert len(got) == len(want)
        for r, (i, h, ws) in zip(got, want, strict=True):
            assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, h, len(ws), sum(c[w] > 0 for w in ws), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            assert r.score == pytest.approx(sum(logp[w] + math.log10(1 - end) for w in ws if w is not None) + math.log10(end), rel=1e-6)
    assert lmscore.score_documents(empty(spark)).count() == 0


def test_expected_counts_of_long_words(monkeypatch):
    pieces = lmscore.normalise([(b"ab", 1), (b"abc", 2), (b"bc", 3), (b"c", 9)], 300)
    table, words = lmscore.prefix_table(pieces), [(b"abcabcbcx" * 4, 3), (b"xyabc", 2)]
    want = lmscore.expected_counts(iter(words), table)
    monkeypatch.setattr(lmscore, "EXPECT_BYTES", 0)
    got = lmscore.expected_counts(iter(words), table)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    long = lmscore.expected_counts(iter([(b"abcx" * 20_000, 1)]), table)
    assert sum(len(k) * v for k, v in long.items()) == pytest.approx(80_000)


def test_long_words_are_scored_whole(spark, monkeypatch):
    rng = random.Random(17)
    rows = [(i, " ".join([prose(rng, 5), "".join(rng.choice("abcé") for _ in range(2500)) if i % 2 else "x"]), "en", "s", 0) for i in range(8)] + [(9, "ab" * 1000 + " " + "AB" * 1000, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    first = sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lmscore.score_documents(df).collect())
    monkeypatch.setattr(lmscore, "LONG_WORD", 10**6)
    assert first == sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lmscore.score_documents(df).collect())


def test_packing():
    x = np.array([0, 1, 255, 256, 70_000, 2**31 - 1])
    assert (lmscore.unpack(lmscore.pack(x)) == x).all() and len(lmscore.unpack(lmscore.pack(x[:0]))) == 0


# --- shared -----------------------------------------------------------------------------------


def test_word_hashes():
    texts = ["", "Añb c d", "x", "  ", "a\x00b A1-b2", LONG]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    for kind, pattern, lower in (("alnum", ALNUM, True), ("space", SPACE, False), ("space_lower", SPACE, True)):
        h, prefix = word_hashes(data, off, kind)
        words = [pattern.findall(t.translate(LOWER) if lower else t) for t in texts]
        assert np.diff(prefix).tolist() == [len(w) for w in words]
        flat = [w for ws in words for w in ws]
        assert len(set(flat)) == len(set(h.tolist())) == len(set(zip(flat, h.tolist(), strict=True)))


def test_shingles_of_few_words():
    """Runs of texts that have fewer words together than a shingle."""
    for texts in (["a b"], ["a"], ["", "a b c"], ["a b c d"], ["a", "b", ""], [""]):
        raw = [t.encode() for t in texts]
        data, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
        row, item, weight, _, _ = neardup.weighted_shingles(data, off)
        assert row.tolist() == [i for i, t in enumerate(texts) if t] and (weight == 1).all()
        # the same text has the same shingle beside longer ones
        n = len(raw[-1])
        beside = neardup.weighted_shingles(np.frombuffer(raw[-1] + b"v w x y z aa", np.uint8), np.array([0, n, n + 12]))
        assert not texts[-1] or item[-1] == beside[1][beside[0] == 0][0]
