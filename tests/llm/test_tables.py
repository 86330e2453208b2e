"""Sharding, url rules and vectors against brute force, and the pipeline on a small corpus."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import sharding, urlfilter, vectors
from skein.llm.queries import RULES


def check_shards(rows, shards, texts, tolerance=None):
    sizes = np.zeros(shards, int)
    slots = {}
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 16, zlib.crc32(t))
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if tolerance:
        assert sizes.max() - sizes.min() <= tolerance * sizes.mean(), sizes
    return sizes


def test_shards(spark):
    rng = np.random.default_rng(1)
    texts = [("é" * int(n)) for n in rng.integers(5, 400, 2500)] + ["same text of a hot group"] * 1200 + [None, ""]
    rows = spark.createDataFrame([(k, t, ["en", None, "de"][k % 3], "s", 7) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, shard int")
    got = sharding.shard_documents(rows, 13).collect()
    assert len(got) == len(texts)
    check_shards(got, 13, texts, 0.15)
    # Copies of one text stay together where the balance allows.
    pairs = [t for t in texts[:100] for _ in range(2)]
    rows = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(pairs)], "doc_id long, text string, lang string, source string")
    where = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(rows, 2).collect()}
    assert sum(where[2 * k] != where[2 * k + 1] for k in range(100)) <= 1


def brute_tree(points, dims, shards):
    """Shard of each of ``points`` (weight, values, content, tie): sorts every node whole."""
    ends = [(min(p[1][d] for p in points), max(p[1][d] for p in points)) for d in range(dims)]
    tolerance = sharding.TOLERANCE * sum(p[0] for p in points) / shards
    out = {}

    def grow(own, first, k):
        if k == 1 or not own:
            out.update((p, first) for p in own)
            return
        share = [(max(points[p][1][d] for p in own) - min(points[p][1][d] for p in own)) / max(1, ends[d][1] - ends[d][0]) for d in range(dims)]
        d = share.index(max(share))
        order = sorted(own, key=lambda p: (points[p][1][d], *points[p][2:]))
        target, at, cuts = sum(points[p][0] for p in own) * (k // 2) / k, 0, []
        for n, p in enumerate([*order, None]):
            apart = n in (0, len(order)) or (points[p][1][d], points[p][2]) != (points[order[n - 1]][1][d], points[order[n - 1]][2])
            cuts.append((abs(at - target), n, apart))
            at += points[p][0] if p is not None else 0
        whole = [c for c in cuts if c[2] and c[0] <= tolerance]
        n = min(whole or cuts)[1]
        grow(order[:n], first, k // 2)
        grow(order[n:], first + k // 2, k - k // 2)

    grow(list(range(len(points))), 0, shards)
    return out


@pytest.mark.parametrize(("sums", "shards"), [(1 << 16, 7), (128, 16), (256, 2)])
def test_shards_equal_brute_force_tree(spark, monkeypatch, sums, shards):
    monkeypatch.setattr(sharding, "SUMS", sums)
    monkeypatch.setattr(sharding, "LEAST_BINS", 4)
    rng = np.random.default_rng(sums)
    points = [(int(rng.integers(1, 60)), (int(rng.choice([3, 9, 500])), int(rng.integers(-(2**61), 2**61)), int(rng.integers(0, 40))), int(rng.choice([7, 8, rng.integers(0, 2**32)])), k * 1000 + 5) for k in range(900)]
    frame = spark.createDataFrame([(k, w, list(v), c, t) for k, (w, v, c, t) in enumerate(points)], "id long, weight long, v array<long>, content long, tie long")
    got = {r["id"]: r["node"] for r in sharding.kd_shards(frame, 3, shards).collect()}
    assert got == brute_tree(points, 3, shards)


@pytest.mark.parametrize("shards", [3, 8])
def test_copies_share_a_shard_whatever_their_metadata(spark, shards):
    rng = np.random.default_rng(shards)
    texts = [f"text {k} " + "x" * int(rng.integers(0, 900)) for k in range(300)]
    rows = [(n, texts[int(k)], f"l{rng.integers(5)}", int(rng.integers(50))) for n, k in enumerate(rng.zipf(1.3, 1500) % 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source int")
    got = {r["doc_id"]: r for r in sharding.shard_documents(frame, shards).collect()}
    groups = {}
    for n, t, _, _ in rows:
        groups.setdefault(t, []).append(n)
    total = sum(len(t) + 16 for _, t, _, _ in rows)
    limit = max(sharding.GROUP * total / shards, max(map(len, texts)) + 16)
    parted = 0
    for t, own in groups.items():
        here = len({got[n]["shard"] for n in own})
        assert here <= -(-len(own) * (len(t) + 16) // limit)
        parted += here > 1
    assert parted <= shards / sharding.GROUP and any(len(own) > 1 for own in groups.values())
    # The tree of the texts' points is that of brute force, and rows lie where their point does.
    def crc(s):
        return zlib.crc32(s.encode())

    table = spark.createDataFrame([(n, hash(t) % 2**40, len(t) + 16, crc(t), [crc(a), b, len(t) + 16], n) for n, t, a, b in rows], "id long, text long, size long, crc long, v array<long>, row long")
    dealt, points = sharding.text_points(table, 3, shards)
    flat = [(r["weight"], tuple(r["v"]), r["content"], r["tie"]) for r in points.collect()]
    assert sum(p[0] for p in flat) == total
    for r in points.collect():
        own = [(crc(rows[n][2]), rows[n][3]) for n in groups[next(t for t in groups if crc(t) == r["crc"])]]
        assert tuple(r["v"][:2]) == (min(a for a, _ in own), min(b for _, b in own))
    wanted = {flat[k]: shard for k, shard in brute_tree(flat, 3, shards).items()}
    placed = {(r["weight"], tuple(r["v"]), r["content"], r["tie"]): r["node"] for r in sharding.kd_shards(points, 3, shards).collect()}
    assert placed == wanted
    assert dealt.groupBy("text", "size", "crc", "part").count().count() == len(flat)


def test_shards_of_few_and_equal_rows(spark):
    rows = spark.createDataFrame([(5, "a", "x", "y")] * 3, "doc_id long, text string, lang string, source string")
    assert len(sharding.shard_documents(rows, 4).collect()) == 3
    assert sharding.shard_documents(rows.limit(0), 4).count() == 0
    assert sharding.shard_documents(rows, 1).agg(F.max("slot")).first()[0] == 2
    # A third of all rows alike in id and text, null ids, extreme numbers, and one text as large as a shard.
    odd = [(5, "same text", 2**63 - 1, None)] * 600 + [(None, f"t{k}" * 20, -(2**63), "s") for k in range(600)] + [(k, "x" * 50, k, "s") for k in range(600)] + [(9, "y" * 20_000, None, "s")]
    frame = spark.createDataFrame(odd, "doc_id long, text string, lang long, source string")
    got = sharding.shard_documents(frame, 8).collect()
    sizes, slots = np.zeros(8, int), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(odd) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sizes.max() <= sizes.mean() + 20_016


def judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, slash, tail = rest.partition("/")
        path = slash + tail
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best.key if best else None, best.verdict if best else "allow"


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://com/en/", "https://A.Example.COM/en/7?x#y", "http://x.example.com/en/8", "http://notcom/en/", "http://ÉÀ.com/en/", "http://example.net/de/80", "http://b.net/de/8"]
    urls += ["http://a.org/es/#/en/", "http://a.org?/es/", "ftp://u:p@a.com:80/en/", "http://a.com#x://b.com/en/", "http://..com/en/", "http://a.com./en/", *[f"http://h{k}.example.com/en/{k}" for k in range(300)]]
    rows = spark.createDataFrame([(k, u, "other") for k, u in enumerate(urls + urls[:3])], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(rows, RULES).collect()}
    assert got == {k: judged(u) for k, u in enumerate(urls + urls[:3])}
    assert urlfilter.judge_urls(rows.limit(0), RULES).count() == 0


def test_long_lists_are_parted(spark, monkeypatch):
    """Lists that need more bits than a filter may have give the same verdicts by several cascades."""
    rng = np.random.default_rng(12)
    hosts = [f"h{k}.{t}" for k in range(60) for t in ("com", "net")]
    rules = [urlfilter.Rule(h, f"/{k % 5}/", "block" if k % 3 else "allow") for k, h in enumerate(hosts[:90])]
    urls = [f"https://{'w.' * int(n)}{rng.choice(hosts)}/{int(rng.integers(0, 6))}/x" for n in rng.integers(0, 3, 400)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    whole = sorted(urlfilter.judge_urls(rows, rules).collect())
    monkeypatch.setattr(urlfilter, "MAX_BITS", 128)
    assert sorted(urlfilter.judge_urls(rows, rules).collect()) == whole and {r["verdict"] for r in whole} == {"allow", "block"} and any(r["rule"] for r in whole)


def test_long_urls(spark):
    """Hosts of very many dots and very long paths are judged like others."""
    urls = ["http://" + "a." * 200_000 + "example.com/en/7", "http://" + "." * 100_000 + "net/de/", "http://b.org/es/" + "x/" * 500_000, "http://" + "c" * 1_000_000, "://" * 100_000]
    got = {r["page_id"]: r for r in urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()}
    assert all((got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == judged(u) for k, u in enumerate(urls))


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{n}" for n in range(3000)]
    listed = set(keys[::7])
    frame = lambda k: spark.createDataFrame([(x,) for x in k], "key string")
    cascade = urlfilter.build_cascade(frame(listed), frame(keys))
    assert len(cascade.levels) > 2
    assert {r["key"] for r in frame(keys).where(cascade.contains(F.col("key"))).collect()} == listed


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (150, 64))
    x = np.concatenate([base, base[:60] + rng.normal(0, 0.09, (60, 64)), base[:20], base[:1] + rng.normal(0, 0.1, (40, 64)), 3 * base[:5]]).astype(np.float32)
    label = np.concatenate([np.arange(150) % 3, np.arange(60) % 3, np.arange(20) % 3, np.zeros(40), np.arange(5) % 3]).astype(int)
    rows = [(k, [float(v) for v in row], int(label[k])) for k, row in enumerate(x)]
    extra = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, rows[0][1], None), (904, [], 1), (905, [None] + rows[0][1][1:], 1), (906, [1.0, 2.0], 0), (907, [2.0, 4.1], 0)]
    frame = spark.createDataFrame([(*r, 5) for r in rows + extra + [rows[7]]], "vec_id long, embedding array<float>, label int, n_links int")
    got = vectors.near_duplicates(frame).collect()
    ids = [r[0] for r in rows] + [7]
    y = np.array([r[1] for r in rows] + [rows[7][1]], np.float32).astype(float)
    lab = np.append(label, label[7])
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = (y @ y.T >= 0.98) & (lab[:, None] == lab)
    want = near.sum(axis=1) - 1
    found = sum(r["n_links"] for r in got if r["vec_id"] < 900)
    assert len(got) == len(ids) + len(extra) and found >= 0.99 * want.sum() and found <= want.sum()
    links = {r["vec_id"]: r["n_links"] for r in got}
    assert [links[k] for k in (900, 901, 902, 903, 904, 905)] == [0] * 6 and links[906] == links[907] == 1
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got) and {r["component_id"] for r in got if r["vec_id"] == 907} == {906}
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_dense_groups_equal_brute_force(spark, monkeypatch):
    """Groups larger than a block, with repeated vectors; counts and components are exact where all pairs are found."""
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "STRIP", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (3, 64))
    x = np.concatenate([base[k % 3] + rng.normal(0, 0.05, 64) * (k % 5) for k in range(300)]).reshape(300, 64)
    x = np.concatenate([x, x[:30], x[:30]]).astype(np.float32)
    rows = [(k, [float(v) for v in row], k % 2) for k, row in enumerate(x)]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (y @ y.T >= 0.98) & (np.arange(360)[:, None] % 2 == np.arange(360) % 2)
    want = near.sum(axis=1) - 1
    found = np.array([got[k]["n_links"] for k in range(360)])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()
    root = np.arange(360)
    while True:
        new = np.array([root[near[k]].min() for k in range(360)])
        if (new == root).all():
            break
        root = new
    assert [got[k]["component_id"] for k in range(360)] == root.tolist()


def test_tables_grow_with_the_rows():
    widths = [vectors.tables_for(n, 0.98) for n in (0, 100, 10_000, 10_000_000, 10**12)]
    assert widths == sorted(widths) and all(t * w <= 10_000 for w, t in widths)
    differ = np.arccos(0.98) / np.pi
    assert all((1 - (1 - differ) ** w) ** t <= vectors.MISSED for w, t in widths)


def test_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(v) for v in rng.normal(0, 1, 1 + k % 40)], 0) for k in range(200)]
    rows += [(1000 + k, [2 * v for v in r[1]], 0) for k, r in enumerate(rows)] + [(None, rows[39][1], 0), (None, [float(v) for v in rng.normal(0, 1, 50)], 3)]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[1000 + k]["n_links"] >= 1 for k in range(200)) and all(got[1000 + k]["component_id"] <= k for k in range(200))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from skein.llm import toxicity

    rng = np.random.default_rng(2)
    text = lambda n=80: " ".join(f"w{v}" for v in rng.integers(0, 3000, n))
    texts = [text() for _ in range(120)]
    texts += [t.upper().replace(" ", "!! ") for t in texts[:40]]
    texts += [text() + f" vile{k}" + text(20) + f" vile{k + 1} vile" for k in range(40)]
    item = text(30)
    texts += [texts[100], text(50) + " " + item]
    marks = [(k, int(not 120 <= k < 160), int(160 <= k < 200)) for k in range(200)]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = toxicity.FIRST_UPDATES, toxicity.LATER_UPDATES
    toxicity.FIRST_UPDATES, toxicity.LATER_UPDATES = 100, 60
    try:
        left = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    finally:
        toxicity.FIRST_UPDATES, toxicity.LATER_UPDATES = before
    assert not left & set(range(120, 160)) and 201 not in left and 200 not in left
    assert len(left & set(range(120))) >= 112 and len(left & set(range(160, 200))) <= 4
