"""Suffix dedup and n-gram join against brute force, and the pipeline."""

import collections
import hashlib
import random
import re

from eventlake.llm import jaccard, suffixes
from eventlake.llm.common import texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def removed(rows, length=100):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, y in zip(raw, gone) if not y)
        out.append((d, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark):
    r = random.Random(1)
    base = ["".join(r.choice("abcd é") for _ in range(r.randint(50, 400))) for _ in range(8)]
    rows = [(i, "".join(x for _ in range(r.randint(0, 4)) for x in (r.choice(base)[r.randint(0, 100) :], "".join(r.choice("xyz") for _ in range(r.randint(0, 30)))))) for i in range(120)]
    rows += [(200, "a" * 500), (201, "a" * 99), (202, None), (203, ""), (204, "ab" * 300), (None, base[0] * 2)]
    got = [tuple(x) for x in suffixes.digests(texts_of(spark.createDataFrame(rows, DOCS))).collect()]
    assert collections.Counter(got) == collections.Counter(removed(rows))


def test_suffix_dedup_edges(spark):
    assert suffixes.digests(texts_of(spark.createDataFrame([], DOCS))).count() == 0
    r = random.Random(2)
    text = "".join(r.choice("abcdef") for _ in range(300))
    got = sorted(tuple(x)[:3] for x in suffixes.digests(texts_of(spark.createDataFrame([(1, text), (1, text), (2, text)], DOCS))).collect())
    assert got == [(1, 300, 0), (1, 300, 0), (2, 300, 300)]  # rows alike are one document


def test_suffix_dedup_without_table_and_in_many_buckets(spark, monkeypatch):
    """The anchors to judge are joined where the bit table is too small, and one string fills many buckets."""
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    hot, other = text(300), text(260)
    rows = [(i, text(r.randint(0, 40)) + (hot if i % 3 == 0 else other[i % 100 :]) + text(r.randint(0, 40))) for i in range(60)] + [(500, text(3_000) + hot + text(3_000))]
    want = collections.Counter(removed(rows))
    frame = texts_of(spark.createDataFrame(rows, DOCS))
    monkeypatch.setattr(suffixes, "BUCKET", 200_000)
    assert collections.Counter(tuple(x) for x in suffixes.digests(frame).collect()) == want
    monkeypatch.setattr(suffixes, "bit_table", lambda keys: None)
    assert collections.Counter(tuple(x) for x in suffixes.digests(frame).collect()) == want


def linked(rows, k=4, percent=85):
    sets, label = {}, {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        label[d] = d
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return sorted((d, len(sets[d]), label[d]) for d in sets)


def near_copies(seed=2):
    r, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(200)]
    for _ in range(25):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 8, 12, 20, 40, 100, 300]))]
        for _ in range(r.choice([1, 2, 5, 9])):
            own = list(words)
            for _ in range(r.randint(0, max(1, len(own) // 40))):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((len(rows) * 3, " ".join(own)))
    return rows


def test_ngram_join(spark):
    rows = near_copies() + [(10000, None), (10001, ""), (10002, " \n"), (10003, "W1 w2"), (10004, "w1 W2")]
    got = jaccard.components(texts_of(spark.createDataFrame(rows, DOCS))).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == linked(rows)


def test_ngram_join_in_blocks(spark):
    """Buckets of few sets a block: what blocks of a bucket have in common is found too."""
    rows = near_copies(7)
    got = jaccard.components(texts_of(spark.createDataFrame(rows, DOCS)), block=2).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == linked(rows)


def test_ngram_join_of_many_near_copies(spark):
    """A group of 2,000 in which most link and many do not, two passages in all of them, and a long text."""
    r = random.Random(8)
    base = [f"v{r.randrange(10_000)}" for _ in range(60)]
    rows = []
    for i in range(2000):
        own = list(base)
        for _ in range(r.choice([1, 1, 2, 4])):
            own[r.randrange(len(own))] = f"n{r.randrange(100_000)}"
        rows.append((i, " ".join(own)))
    long = [f"u{r.randrange(50_000)}" for _ in range(60_000)]
    rows += [(5000, " ".join(long)), (5001, " ".join([*long[:-300], "end"])), (5002, " ".join(long[:40_000]))]
    got = sorted(map(tuple, jaccard.components(texts_of(spark.createDataFrame(rows, DOCS))).select("doc_id", "n_shingles", "component_id").collect()))
    sets = [frozenset(zip(*(t.split()[k:] for k in range(4)))) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x] = label[label[x]]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a) >= 85 * len(sets[j]) and 100 * len(sets[j]) >= 85 * len(a) and find(i) != find(j) and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    assert got == [(d, len(sets[i]), rows[find(i)][0]) for i, (d, _) in enumerate(rows)]


def test_equality_is_of_bytes(spark):
    s = "a"
    for _ in range(11):
        s += s.translate(str.maketrans("ab", "ba"))
    other = s.translate(str.maketrans("ab", "ba"))  # equal to s for every polynomial hash modulo 2 ** 64
    rows = [(1, s), (2, other), (3, s)]
    got = jaccard.components(texts_of(spark.createDataFrame(rows, DOCS))).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
    assert jaccard.ngrams(s.encode(), 4) != jaccard.ngrams(other.encode(), 4)


def test_sketches_bound_the_difference():
    import numpy as np

    r = np.random.default_rng(3)
    for n in (1, 5, 80, 90, 400, 5000):
        a = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.sort(np.concatenate([a[n // 5 :], r.integers(0, 1 << 63, n // 9, dtype=np.uint64)]))
        if not len(b):
            continue
        x, y = (jaccard.sketches(np.zeros(len(h), np.int64), h, np.array([len(h)]))[0].as_py() for h in (a, b))
        x, y = (np.unpackbits(np.frombuffer(z, np.uint8)) for z in sorted((x, y), key=len))
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert (x != y).sum() <= n // 5 + n // 9


def test_signatures_miss_no_link():
    """Every pair that links shares a signature, also where segments are empty."""
    import numpy as np

    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(6, 150))
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        most = int(15 * (2 * n) // 185)
        drop, add = int(r.integers(0, most + 1)), 0
        add = most - drop
        b = np.concatenate([a[drop:], r.integers(0, 1 << 63, add, dtype=np.uint64)])
        common = n - drop
        if 100 * common < 85 * (n + add):
            continue
        row = np.concatenate([np.zeros(n, np.int64), np.ones(len(b), np.int64)])
        rows, sig, role = jaccard.signatures(row, np.concatenate([np.sort(a), np.sort(b)]), 2, 85)
        if drop + add:
            assert set(sig[rows == 0]) & set(sig[rows == 1]), (n, drop, add)


def test_representatives(spark):
    rows = [(5, "one two three four five six seven"), (3, "One two three four five six seven"), (9, "other words are all here now ok"), (1, None), (2, "")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "'c' as label", "1 as node")
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 9]
    twice = spark.createDataFrame([*rows, rows[1], (None, "other words are all here now ok"), (2, "")], DOCS)
    assert sorted((r["doc_id"] or -1) for r in jaccard.representatives(twice).collect()) == [-1, 1, 2, 2, 3]


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, sf)
        assert made.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_against_brute_force(spark):
    """Every stage on all that its predecessor kept."""
    import corpus_pipeline
    from eventlake.llm import mixing, packing, pii, toxicity
    from eventlake.llm.common import table

    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, sf, "documents")
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    model = toxicity.fit(texts_of(docs), table(spark, sf, "labels"))
    toxic = {r["doc_id"] for r in toxicity.score(texts_of(docs), model).where("predicted = 1").collect()}
    clean = stages["toxicity"](spark, docs, sf)
    assert text(clean) == {d: t for d, t in text(docs).items() if d not in toxic}
    kept = stages["near_duplicates"](spark, clean, sf)
    label = {d: c for d, _, c in linked(sorted(text(clean).items()), 5, 80)}
    assert text(kept) == {d: t for d, t in text(clean).items() if label[d] == d}
    plain = stages["personal_data"](spark, kept, sf)
    before, after = text(kept), text(plain)
    found = dict(zip(before, pii.spans([t or "" for t in before.values()], *pii.fit())))
    assert after == {d: t if t is None else pii.blacked(t, found[d][1]) for d, t in before.items()}
    assert not any(pii.base(t or "") for t in after.values())
    mixed = stages["mixing"](spark, plain, sf)
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.weigh(plain).collect() if r["size"]}
    got = collections.Counter(r["doc_id"] for r in mixed.where("length(trim(text)) > 0").collect())
    assert {d: n for d, n in got.items() if d in want} == {d: n for d, n in want.items() if n}
    rows = stages["packing"](spark, mixed, sf).collect()
    pieces = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(texts_of(mixed)).collect())
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    full = collections.defaultdict(list)
    for r in rows:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in full.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
