"""Each operator against a brute-force version, an exact round trip or held-out labels, and on odd tables."""

import base64
import collections
import gzip
import hashlib
import io
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pitspark.llm import components, decontaminate, exact_dedup, langid, mixing, quality, queries, secrets, sharding, simhash, token_output, warc
from pitspark.llm.common import Scratch, crc_mod, filesystem, new_path, words_in

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, key long, bucket int, fp string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(1)
    base = prose(rng, 80)
    long = prose(rng, 30_000)
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, base.replace("alpha", "beta", 1), "en", "b"), (3, None, None, None), (4, "", "de", "b"), (None, base, "en", None), (None, None, None, "c"), (5, long, "en", "a"),
        (6, long, "en", "c"), (7, " \t\n", "fr", "c"), (8, "one two", "fr", "a"), (8, "one two", "fr", "a"), (9, "ONE  TWO", "es", "é"), (10, "Ünï cödé   x", "de", "b"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "r", 2, 3, "f") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(spark, odd, nothing):
    got = sharding.write_shards(sharding.shard_documents(odd, 5, 3, bucket_bytes=100_000))
    rows = got.select("shard", "slot", "size", "row.doc_id", "row.text").collect()
    want = collections.Counter((r["doc_id"], r["text"]) for r in odd.collect())
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows) == want
    per = collections.defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 16
    assert all(sorted(v) == list(range(len(v))) for v in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    again = sharding.shard_documents(odd.repartition(1), 5, 3, bucket_bytes=100_000).select("shard", "slot", "row.doc_id", "row.text").collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter((r["shard"], r["slot"], r["doc_id"], r["text"]) for r in rows)
    assert sharding.shard_documents(nothing, 5).count() == 0
    same = spark.range(1, 2).select(F.lit(1).alias("doc_id"), F.lit("x" * 50).alias("text")).crossJoin(spark.range(300)).drop("id")
    assert sharding.shard_documents(same, 4, bucket_bytes=1000).groupBy("shard").count().where("count = 75").count() == 4


def test_sharding_of_odd_columns(spark):
    """Map columns, dots in names, and the digest columns of the registered query."""
    df = spark.createDataFrame([(i, None if i == 3 else f"té{i}") for i in range(50)] + [(7, "té7")] * 3, "doc_id long, text string")
    df = df.withColumn("a.b", F.col("doc_id")).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("deep", F.struct(F.create_map(F.lit("k"), F.lit(1)).alias("m")))
    rows = sharding.write_shards(sharding.shard_documents(df, 4, 2, bucket_bytes=200)).select("shard", "slot", "row.*").collect()
    assert collections.Counter((r["doc_id"], r["a.b"], r["m"]["k"]) for r in rows) == collections.Counter((r[0], r[0], r[0]) for r in df.collect())
    assert sorted(collections.Counter(r["shard"] for r in rows).values()) == [13, 13, 13, 14]


def test_sharding_query_against_plain_python(spark):
    got = queries.op1_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    n = collections.Counter(r["shard"] for r in got)
    assert set(n) <= set(range(40)) and max(n.values()) - min(n[k] for k in range(40)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n[k])) for k in n)


def brute_fingerprint(text, k):
    toks = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not toks:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(toks[i : i + k]).encode(), 42) for i in range(max(1, len(toks) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_agree_with_spark_hash_and_brute_force(spark):
    rng = random.Random(2)
    for t in [None, "", "A", "Ab c", prose(rng, 4), prose(rng, 300), "Ünï É x y z", "  a b c d"]:
        assert int.from_bytes(simhash.simhash(t), "big") == brute_fingerprint(t, 4)
        assert simhash.simhash(t, 4, 4)[:8] == simhash.simhash(t)
    assert spark.sql("select xxhash64('a b c d') & 9223372036854775807 as h").first()["h"] == xxhash.xxh64_intdigest(b"a b c d", 42) & (1 << 63) - 1


def groups_of(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tile_rows", [7, 64, 10_000])
def test_near_duplicates_against_all_pairs(spark, tile_rows):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = {}
    for i in range(260):
        x = rng.choice(seeds) if i % 2 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        prints[i] = x
    prints = {v: k for k, v in prints.items()}  # distinct
    ids = {k: v for v, k in prints.items()}
    want = groups_of(sorted(ids), lambda a, b: (ids[a] ^ ids[b]).bit_count() <= 4)
    df = spark.createDataFrame([(k, bytearray(v.to_bytes(8, "big"))) for k, v in ids.items()], "node long, fp binary")
    got = {r["node"]: r["root"] for r in simhash.near_duplicate_nodes(df, 4, 1, Scratch(spark, "t"), tile_rows).collect()}
    assert {k: got.get(k, k) for k in ids} == want


def test_wide_fingerprints_and_pruning():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    x[100:150] = x[:50] ^ (np.uint64(1) << rng.integers(0, 63, (50, 4), dtype=np.uint64))
    member, root = simhash.tile_links(x, None, 10)
    assert sorted(member.tolist()) == list(range(100, 150)) and sorted(root.tolist()) == list(range(50))
    member, root = simhash.tile_links(x[:60], x[100:150], 10)
    assert len(member) == 50


def test_near_duplicate_table(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["component_id"])
    assert by[0] == by[1] == {0} and by[3] == by[4] == by[7] == {3} and by[5] == by[6] == {5} and by[8] == by[9] == {8} and by[None] == {0, 3}
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one_per_group(nothing).count() == 0
    kept = simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 5, 8, 10]


def test_stage_threshold_finds_near_copies_and_spares_others(spark):
    rng = random.Random(5)
    docs, near = [], []
    for i in range(60):
        w = prose(rng, 300).split()
        docs.append((2 * i, " ".join(w)))
        for _ in range(3):
            w[rng.randrange(len(w))] = "edited"
        docs.append((2 * i + 1, " ".join(w)))  # three edits touch at most 15 of 296 shingles
        near.append(2 * i + 1)
    kept = {r["doc_id"] for r in simhash.keep_one_per_group(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(60)}


def shingle_similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_stage_decides_by_exact_similarity(spark):
    rng = random.Random(11)
    docs, want, real = [], set(), 0
    while len(docs) < 600:  # pairs around the threshold, some of a few shingles only
        w = prose(rng, rng.choice([8, 9, 60, 150, 300])).split()
        v = w[:] if len(w) > 10 else w + [prose(rng, 1)]
        for _ in range(rng.randint(1, 1 + len(w) // 30) if len(w) > 10 else 0):
            v[rng.randrange(len(v))] = "edited"
        a, b = " ".join(w), " ".join(v)
        j = shingle_similarity(a, b)
        if 0.7 <= j < 0.8 or 0.8 <= j < 0.86:
            k = len(docs)
            docs += [(k, a), (k + 1, b)]
            want |= {k} if j >= 0.8 else {k, k + 1}
            real += j >= 0.8
    assert real >= 100 and len(docs) // 2 - real >= 50
    # Unrelated texts around the same repeated line stay; a copy that repeats a line of its own more often goes.
    line, k = prose(rng, 10), len(docs)
    docs += [(k + i, f"{prose(rng, 150)} {' '.join([line] * 40)}") for i in range(20)]
    want |= {k + i for i in range(20)}
    base = prose(rng, 150)
    docs += [(k + 20 + i, f"{base} {' '.join([line] * n)}") for i, n in enumerate((2, 400))]
    want |= {k + 20}
    kept = {r["doc_id"] for r in simhash.keep_one_per_group(spark.createDataFrame(docs, "doc_id long, text string"), tile_rows=200).collect()}
    assert kept == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    assert components.connected_components(star, Scratch(spark, "t")).where("root = 0").count() == 3000
    assert components.connected_components(star.where("false"), Scratch(spark, "t")).count() == 0


def brute_tiles(doc, item, least):
    """Greedy string tiling by its definition: the longest unmarked match first, earliest on ties."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in used_d and i + n not in used_i:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (d, i, n)
        if best is None:
            return out
        d, i, n = best
        used_d |= set(range(d, d + n))
        used_i |= set(range(i, i + n))
        out.append(best)


def test_tiles_against_definition():
    rng = np.random.default_rng(1)
    for n in range(1000):
        words = int(rng.integers(1, 8))
        item = rng.integers(1, 1 + words, rng.integers(3, 60 if n % 10 == 0 else 25)).astype(np.uint64)
        cut = int(rng.integers(0, len(item)))
        part = lambda: rng.integers(0, 1 + words, rng.integers(0, 10)).astype(np.uint64)
        doc = np.concatenate([part(), item[cut:], part(), item[: cut + 1], part(), item[cut // 2 :][::-1]])
        least = int(rng.integers(1, 5))
        got = decontaminate.tiles(decontaminate._mixed(doc) * (doc > 0), decontaminate._mixed(item), least)
        assert got == brute_tiles([int(x) or -1 for x in doc], item.tolist(), least)


def test_tiles_of_repetitive_texts_are_quick():
    one = np.ones(20_000, np.uint64)
    began = time.perf_counter()
    assert sum(n for *_, n in decontaminate.tiles(one, one[:2000], 5)) == 2000
    rng = np.random.default_rng(2)
    decontaminate.tiles(rng.integers(1, 3, 20_000).astype(np.uint64), rng.integers(1, 3, 2000).astype(np.uint64), 5)
    assert time.perf_counter() - began < 20


def test_word_hashes_in_chunks(monkeypatch):
    rng = random.Random(3)
    texts = ["", "A b_1, c", "é Ünï x", "x" * 1000 + " y " + "z" * 300, prose(rng, 400), " ".join("w" * rng.randint(1, 90) for _ in range(100))]
    whole = [decontaminate.word_hashes(t).tolist() for t in texts]
    assert [len(w) for w in whole] == [len(re.findall(r"\w+", t)) for t in texts]
    assert len({h for w in whole for h in w}) == len({x for t in texts for x in re.findall(r"\w+", t.lower())})
    monkeypatch.setattr(decontaminate, "_CHUNK", 64)
    assert [decontaminate.word_hashes(t).tolist() for t in texts] == whole
    w = decontaminate.word_hashes(texts[4])
    assert np.array_equal(decontaminate.windows(w, 5)[100:], decontaminate.windows(w[100:], 5))


def test_decontamination(spark, odd, nothing):
    rng = random.Random(7)
    items = [(i, prose(rng, 24)) for i in range(5)] + [(5, "too short"), (6, ""), (7, None), (None, prose(rng, 12))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole, moved = items[0][1], items[1][1].split()
    docs = [
        (0, prose(rng, 50) + " " + whole.upper().replace(" ", ", ") + " " + prose(rng, 9)), (1, " ".join(moved[12:] + ["stop"] + moved[:12])), (2, prose(rng, 200)), (3, " ".join(items[2][1].split()[:8])), (4, None), (5, ""),
        (6, "é " + items[3][1]), (None, items[8][1]), (7, "It is TOO short."), (8, "too, very short"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most_bits in (1 << 24, 64):  # the full filter lets every seed through
        got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.contaminated(df, bench, most_bits=most_bits).collect()}
        assert got == {(0, 0): 1.0, (1, 1): 1.0, (6, 3): 1.0, (None, None): 1.0, (7, 5): 1.0}
    assert sorted(r["doc_id"] for r in decontaminate.contaminated(df, bench, keep=True).collect()) == [2, 3, 4, 5, 8]
    assert decontaminate.contaminated(nothing, bench).count() == 0 and decontaminate.contaminated(odd, bench.where("false")).count() == 0
    assert decontaminate.contaminated(odd, bench.where("false"), keep=True).count() == odd.count()


def test_decontamination_of_a_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    by_seed = collections.defaultdict(set)
    for k, w in items.items():
        for i in range(len(w) - 4):
            by_seed[tuple(w[i : i + 5])].add(k)
    want = {}
    for r in docs.collect():
        w = words(r["text"])
        hit = [i for i in range(len(w) - 4) if tuple(w[i : i + 5]) in by_seed]
        near = sorted({j for i in hit for j in range(max(0, i - 5), i + 10)})
        for k in {k for i in hit for k in by_seed[tuple(w[i : i + 5])]}:
            n = sum(x[2] for x in brute_tiles([w[j] if j < len(w) else None for j in near], items[k], 5))
            if n / len(items[k]) >= 0.5:
                want[(r["doc_id"], k)] = n
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 0


def test_warc_round_trip(spark):
    pages = [(3, "http://x/\r\n3", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (None, "u", "<p>é</p>"), (4, "u", ""), (5, "u", "x" * 300_000), (5, "u", "x" * 300_000), (None, None, "only")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = warc.write_archives(df, file_bytes=500)
    rows = warc.read_archives(spark, path, partition_bytes=800).collect()
    assert len(rows) == len(pages)
    for r in rows:
        html = next((h or "").encode() for p, u, h in pages if p == r["page_id"] and (p is not None or base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r["payload_digest"]))
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert r["payload"] == (html if r["record_type"] == "response" else None)
    by = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in rows)
    assert by == [(-1, "response", None), (-1, "revisit", 1), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "revisit", 2), (5, "response", None), (5, "response", None)]
    assert warc.read_archives(spark, path).where("record_type = 'revisit'").count() == 3
    assert warc.read_archives(spark, path).where("page_id in (4, 5) and payload_bytes > 0").count() == 2
    assert warc.read_archives(spark, path, payload=False).where("payload is not null").count() == 0
    assert warc.read_archives(spark, warc.write_archives(df.where("false"))).count() == 0
    big = warc.with_revisits(df, min_bytes=5)
    assert big.where("is_revisit").count() == 2


def test_warc_skips_payloads_and_finds_damage():
    raw = b"".join(warc.member(warc.record(i, "u", random.Random(i).randbytes(50_000), None, False, "2000-01-01T00:00:00Z"), 1) for i in range(20))
    stats = {}
    got = list(warc.records(io.BytesIO(raw), lambda h: h["page_id"] == 7, True, stats))
    assert [h["page_id"] for h in got] == [7] and stats["records"] == 20 and stats["inflated"] < 100_000
    assert zlib.decompress(raw[: int.from_bytes(raw[16:20], "little")], 31).startswith(b"WARC/1.1\r\nWARC-Type: response")
    assert gzip.decompress(raw).count(b"WARC/1.1") == 20  # a standard reader takes member by member
    broken = bytearray(raw)
    broken[30_000] ^= 255
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(bytes(broken))))


def standard_archive():
    """An archive as other tools write it: records of several types, folded and odd headers, none of this module's fields."""
    html = "<p>é</p>".encode() * 3000
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    rows = [
        ("warcinfo", "application/warc-fields", b"software: x\r\nformat: WARC File Format 1.0\r\n", ""), ("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", ""),
        ("response", "application/http; msgtype=response", http + html, f"WARC-Payload-Digest: sha1:{warc.payload_digest(html)}\r\n"), ("metadata", "application/warc-fields", b"via: y\r\n", ""),
        ("resource", "text/plain", b"plain text", ""), ("response", "application/http;msgtype=response", http, ""), ("conversion", "text/plain", b"", ""),
        ("revisit", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", ""),
    ]
    raw = [f"WARC/1.0\r\nWARC-Type:{t}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nX-Long: a\r\n b\r\n{more}Content-Type: {kind}\r\ncontent-length:  {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n" for i, (t, kind, block, more) in enumerate(rows)]
    want = [(t, None if t == "revisit" else block[len(http):] if t == "response" else b"" if t == "request" else block) for t, _, block, _ in rows]
    return raw, want


@pytest.mark.parametrize("form", ["plain", "members", "one member", "mixed"])
def test_warc_reads_standard_archives(form):
    raw, want = standard_archive()
    packed = {"plain": b"".join(raw), "members": b"".join(map(gzip.compress, raw)), "one member": gzip.compress(b"".join(raw)), "mixed": b"".join(warc.member(r, 1) if i < 3 else gzip.compress(r) for i, r in enumerate(raw))}[form]
    got = list(warc.records(io.BytesIO(packed)))
    assert [(r["record_type"], r["payload"]) for r in got] == want
    assert [r["payload_bytes"] for r in got] == [77 if t == "revisit" else len(p) for t, p in want]
    stats = {}
    few = list(warc.records(io.BytesIO(packed), lambda h: h["record_type"] == "resource", False, stats))
    assert [(r["record_id"], r["payload"]) for r in few] == [("<urn:uuid:4>", None)] and stats["records"] == len(raw)
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(packed[: len(packed) // 2] if form != "plain" else packed.replace(b"WARC/1.0\r\nWARC-Type:metadata", b"XXXX/1.0\r\nWARC-Type:metadata"))))


def test_warc_source_reads_folders_and_sweeps_attempts(spark):
    raw, want = standard_archive()
    path = new_path(spark, "standard")
    fs, root = filesystem(path)
    for name, data in (("a/b/one.warc", b"".join(raw)), ("two.warc.gz", b"".join(map(gzip.compress, raw))), ("a/.hidden.warc", b"junk"), ("note.txt", b"junk"), ("empty.warc", b"")):
        fs.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(data)
    rows = warc.read_archives(spark, path).select("record_type", "payload").collect()
    norm = lambda p: None if p is None else bytes(p)
    assert collections.Counter((r[0], norm(r[1])) for r in rows) == collections.Counter(want * 2)
    assert warc.read_archives(spark, path).where("content_type = 'text/plain'").count() == 4
    df = spark.createDataFrame([(-5, "u", "x")], "page_id long, url string, html string")
    path = warc.write_archives(df)
    writer = warc.WarcWriter({"path": path})
    fs, root = filesystem(path)
    for name in (f".part-{writer.write_id}-00000-000-7.tmp", f".part-{writer.write_id}-00001-000-8.tmp", ".part-other-00000-000-9.tmp"):
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(b"x")
    writer.commit([warc._Written([f".part-{writer.write_id}-00000-000-7.tmp"], 1), None])
    left = sorted(x.path.rpartition("/")[2] for x in fs.get_file_info(warc.FileSelector(root)))
    assert len(left) == 3 and left[0] == ".part-other-00000-000-9.tmp" and all(x.endswith(".warc.gz") for x in left[1:])
    assert [r["page_id"] for r in warc.records(fs.open_input_file(f"{root}/{next(x for x in left[1:] if '000-7' not in x and writer.write_id not in x)}"))] == [-5]


def water(sizes, budget=1.5, weights=(3, 1, 2), cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, total, open_ = {}, budget * sum(sizes.values()), set(names)
    while open_:
        share = {s: (total - sum(out.values())) * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        out |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return out


def sainte_lague(targets, seats):
    got = collections.Counter()
    order = sorted(targets, key=lambda s: (s is None, (s or "").encode()))
    for _ in range(seats):
        got[max(order, key=lambda s: (targets[s] / (2 * got[s] + 1), -order.index(s)))] += 1
    return got


def test_mixing_against_plain_python(spark, odd, nothing):
    rng = random.Random(9)
    docs = [(i, prose(rng, rng.randint(0, 120)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df, n_shards=5, blocks_per_shard=40, bucket_rows=30).collect()
    sizes = collections.Counter()
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]][1].split())
        sizes[r["source"]] += r["size"]
    targets = water(sizes)
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    block = sum(targets.values()) / 200
    assert all(abs(taken[s] - targets[s]) <= 2 * block for s in sizes)
    quotas = mixing.apportion(mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")), 5, 40).collect()
    assert {s: sum(q["quota"] for q in quotas if q["source"] == s) for s in sizes} == sainte_lague(targets, 200)
    assert all(sum(q["quota"] for q in quotas if q["shard"] == k) == 40 for k in range(5))
    again = mixing.mix(df.repartition(7), n_shards=5, blocks_per_shard=40, bucket_rows=30).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    # Each shard has its quota of blocks of each source, but for what is cut at ends of passes and at the target.
    held = mixing.mixed_documents(df, with_shard=True, n_shards=5, blocks_per_shard=40).groupBy("shard", "source").agg(F.sum(words_in(F.col("text"))).alias("n")).collect()
    quota = {(q["shard"], q["source"]): q["quota"] for q in quotas}
    width, longest = round(block), max(r["size"] for r in rows)
    for h in held:
        assert abs(h["n"] - quota.get((h["shard"], h["source"]), 0) * width) <= 3 * width + 2 * longest, h
    assert {h["shard"] for h in held} == set(range(5))
    out = mixing.mixed_documents(df, n_shards=5, blocks_per_shard=40)
    assert out.columns == df.columns
    mixed = out.groupBy("source").agg(F.sum(words_in(F.col("text"))).alias("n")).collect()
    assert all(abs(r["n"] - targets[r["source"]]) <= 2 * block for r in mixed)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mix(df.withColumn("text", F.lit(" "))).agg(F.sum("taken")).first()[0] == 0


def test_mixing_blocks_take_their_seats(spark):
    """One-word documents: every block of a source lies in the shard of its seat, by a plain count of the quota table."""
    docs = [(i, "w", "abc"[i % 7 % 3]) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df, n_shards=6, blocks_per_shard=50, bucket_rows=500).select("doc_id", "source", "target", F.explode("pieces").alias("p")).collect()
    have = collections.Counter((r["p"]["shard"], r["source"]) for r in got)
    targets = {r["source"]: r["target"] for r in got}
    order, quota, dealt = sorted(targets), collections.Counter(), collections.Counter()
    for seat in range(300):
        s = max(order, key=lambda x: (targets[x] / (2 * dealt[x] + 1), -order.index(x)))
        dealt[s] += 1
        quota[(seat // 50, s)] += 1
    width = round(sum(targets.values()) / 300)
    assert width > 1 and all(abs(have[k] - quota[k] * width) <= 3 * width for k in set(have) | set(quota))
    assert sum(abs(have[k] - quota[k] * width) > width for k in quota) <= 3  # the shards of the sources' last seats
    same = spark.createDataFrame([(1, "one two three", "s")] * 400, "doc_id long, text string, source string")  # equal in id and text
    rows = mixing.mix(same, n_shards=3, blocks_per_shard=9).collect()
    assert len(rows) == 400 and sum(r["taken"] for r in rows) == 1800 and max(r["taken"] for r in rows) <= 6


def test_mixing_gives_every_small_source_its_target(spark):
    rng = random.Random(10)
    docs = [(i, "w " * 60, "hot") for i in range(500)] + [(500 + i, "w " * rng.randint(1, 12), f"site{i % 1500}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df, n_shards=4, blocks_per_shard=32).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 1501 and all(abs(r["taken"] - r["target"]) <= 0.5 + 1e-6 for r in got)
    out = mixing.mixed_documents(df, n_shards=4, blocks_per_shard=32)
    assert out.select("source").distinct().count() == 1501
    few = mixing.mix(df.where("doc_id between 500 and 520")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.5 + 1e-6 for r in few)  # fewer words than blocks asked for
    targets = {"hot": 1000.0} | {f"s{i}": 5.0 for i in range(200)}  # the highest quotients are above the hot source's share and two
    quotas = mixing.apportion(spark.createDataFrame(list(targets.items()), "source string, target double"), 4, 10).collect()
    dealt = collections.Counter()
    for q in quotas:
        dealt[q["source"]] += q["quota"]
    assert dealt == {k: n for k, n in sainte_lague(targets, 40).items() if n}


def test_secret_base_patterns():
    t = 'x "API_KEY": "abc.def-1" token=ab secret: token: abcdef12 AKIA' + "A1" * 8 + " AKIA123 " + "ab" * 12 + " " + "f" * 23
    got = secrets.base_spans(t)
    assert [(secrets.KINDS[k], t[i:j]) for i, k, j in got] == [("assign", 'API_KEY": "abc.def-1'), ("access", "AKIA" + "A1" * 8), ("hex", "ab" * 12)]
    assert secrets.base_spans("paſſword=abcdef12") == [] and secrets.base_spans("toKen=abcdef12") == []


def brute_base(text):
    """The base spans by a scanner of single characters."""
    text, out = text or "", []
    key = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    at = 0
    while at < len(text):
        low = text[at : at + 8].lower() if text[at : at + 8].isascii() else "".join(c.lower() if c.isascii() else "\0" for c in text[at : at + 8])
        step = at + 1
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if not low.startswith(name):
                continue
            i = at + len(name)
            i += text[i : i + 1] in ("'", '"')
            while text[i : i + 1] == " ":
                i += 1
            if text[i : i + 1] not in (":", "="):
                continue
            i += 1
            while text[i : i + 1] == " ":
                i += 1
            # The quote is optional, and "=" may belong to the value.
            j = i + (text[i : i + 1] in ("'", '"'))
            end = run(j, key)
            if end > j:
                if end - j >= 6:
                    out.append((at, 0, end))
                step = end
                break
        at = step
    for kind, head, allowed, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            if text.startswith(head, at) and (end := run(at + len(head), allowed)) > at + len(head):
                if end - at >= least:
                    out.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(out)


def test_base_columns_of_whole_tables_against_a_scanner(spark):
    """Every row of a table of the driver's, with secrets planted in some."""
    rng = random.Random(21)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    bits = ["token=", "Secret : '", 'API_KEY"="', "password==", "ab", "AKIA", "A1B2C3D4", "0f" * 6, "é", " ", "-x/", "tokentoken=abcdef", "apikey:", "passwd = ", "Q" * 12, "f" * 24, "\n", "ſecret=abcdefg"]
    rows += [(10**6 + i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(1500)] + [(2 * 10**6, None), (None, "token=abcdef123")]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    at = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    positive = 0
    for doc, text in rows:
        base, r = brute_base(text), at[doc]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for _, k, _ in base) for kind in range(3)], text
        flat = [f"{('assign', 'access', 'hex')[k]}:{i}:{j}" for i, k, j in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(flat).encode()).hexdigest()
        assert set(flat) <= set(r["spans"].split(",")) and len(r["scores"]) == len([x for x in r["spans"].split(",") if x])
        positive += bool(base)
    assert positive > 300


def test_secret_network_on_held_out_documents(spark, odd, nothing):
    """Recall and precision on documents that no part of the training saw, and on new findings of the generator."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    net = secrets.train(docs.where("doc_id % 2 = 0"))
    texts = [r["text"] for r in docs.where("doc_id % 2 = 1").collect()]
    found = secrets.scan(texts, net)
    scores = [p for base, every in found for *_, p in every[: len(every)] if base]
    assert np.mean([p >= net.threshold for p in scores]) >= 0.9 and len(scores) > 50
    added = [(t, s) for t, (_, every) in zip(texts, found) for s in every if s[1] == 3]
    assert len(added) <= len(texts) / 500 and not any("@" in t[max(0, i - 1) : j + 1] for t, (i, _, j, _) in added)
    rng = random.Random(123)
    made = [secrets._finding(rng) for _ in range(1500)]
    hit = np.array([any(2 * (min(b, j) - max(a, i)) >= min(j - i, secrets.SPAN) for a, _, b, _ in every) for (_, i, j, _), (_, every) in zip(made, secrets.scan([m[0] for m in made], net))])
    label = np.array([y for *_, y in made], bool)
    assert hit[label].mean() > 0.95 and hit[~label].mean() < 0.03
    text = "plain words " * 2000 + "login ghp_a8Kd02LmQpZ7xV1cN5bT3yR6wE9uS4hJ0fGq end, my key is Xk9fQ2mL7pR4 token = deadbeefdeadbeefdeadbeef00 " + "more " * 10
    ((base, every),) = secrets.scan([text], net)
    assert {k for _, k, _ in base} == {0, 2} and {text[i:j] for i, k, j, _ in every if k == 3} == {"ghp_a8Kd02LmQpZ7xV1cN5bT3yR6wE9uS4hJ0fGq", "Xk9fQ2mL7pR4"}
    rows = secrets.find_secrets(odd).collect()
    assert len(rows) == odd.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["n_hex"] == 0 for r in rows)
    assert secrets.find_secrets(nothing).count() == 0


def test_secret_training_takes_every_finding(spark):
    """Labels, fit, calibration and threshold over all findings of more documents than a bounded draw would hold, against plain numpy."""
    rng = random.Random(5)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    rows = [(i, f"{pick('etaoinshr', 6)} password={pick('abcXYZ0123456789', rng.randint(9, 20))} or {pick('etaoin', 5)}-{pick('0123456789', 6)}.") for i in range(9000)]
    rows += [(9000, None), (9001, "")] + rows[:50]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = [set(), set(), set()]
    for i, text in rows:
        parts[(0, 0, 1, 2)[zlib.crc32(str(i).encode()) % 4]] |= {(label, x.astype(np.uint8).tobytes()) for x, label in secrets.findings_in(text or "")}
    stacked = lambda some: np.array([np.frombuffer(x, np.uint8) for _, x in some]).astype(np.int64)
    net = secrets.train(docs)

    mine = net.probability(stacked([f for f in parts[2] if f[0]]))
    made = np.array([net.probability(np.array(w)).max() if w else 0.0 for w, label in secrets.generated(2000, 3) if label])
    assert len(mine) > 2000 and len(made) < len(mine)
    below = lambda t: (made < t).mean() + (mine < t).mean()
    assert below(net.threshold - 1e-9) <= 2 * 0.02 <= below(net.threshold + 1e-9)  # both kinds of positives weigh alike

    x, y = stacked(parts[1]), np.array([label for label, _ in parts[1]])
    other = [(w, label) for windows, label in secrets.generated(2000, 2) for w in windows]
    z, y = net.logits(np.concatenate((x, [w for w, _ in other]))), np.concatenate((y, [label for _, label in other]))
    by = np.where(np.arange(len(y)) < len(x), 1.0, max(1.0, len(x) / len(other)))
    n, good, spread = by.sum(), by[y > 0].sum(), (by @ z**2 / by.sum() - (by @ z / by.sum()) ** 2) ** 0.5
    off = by * (1 / (1 + np.exp(-(net.scale * z + net.shift))) - np.where(y > 0, (good + 1) / (good + 2), 1 / (n - good + 2)))
    assert abs(off @ z / spread / n + 1e-3 * net.scale * spread) < 1e-6 and abs(off.mean() * len(off) / n + 1e-3 * net.shift) < 1e-6

    found = secrets.labelled(docs)
    assert {(r["part"], r["label"], bytes(r["x"])) for r in found.collect()} == {(k, *f) for k, part in enumerate(parts) for f in part} and found.count() == sum(map(len, parts))
    first, start = found.where("part = 0"), [a + 0.0 for a in secrets._made(0, 8000)[1]]
    fits = [secrets.fit(some, len(parts[0]), start, secrets._flat(secrets.generated(4000, 1)), rates=(1e-3,), rows=4000) for some in (first, first.repartition(7))]
    assert all(learned == len(parts[0]) for _, learned in fits) and all(np.array_equal(a, b) for a, b in zip(fits[0][0], fits[1][0]))
    assert (np.bincount(secrets.order_of(10, 35, np.random.default_rng(0)), minlength=10) == 4).all() and sorted(secrets.order_of(100, 35, np.random.default_rng(0))) == list(range(100))


def test_secrets_in_long_runs_and_without_digits():
    net = secrets.trained()
    rng = random.Random(7)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    middle, plain, after = [], [], []
    for _ in range(100):
        key, path = pick(letters + "0123456789", 40), "/".join(pick("etaoinshrdlu", 6) for _ in range(14))
        middle.append((f"see {path}/{key}/{path} now", key))
        key = pick(letters, 32)
        plain.append((f"the key = {key} is", key))
        key = pick(letters + "0123456789", 40)
        after.append((f"id {pick('0123456789abcdef', 24)}/{key} end", key))
    for made in (middle, plain, after):
        got = secrets.scan([t for t, _ in made], net)
        assert np.mean([any(k == 3 and t[i:j].find(key[4:-4]) >= 0 for i, k, j, _ in every) for (t, key), (_, every) in zip(made, got)]) > 0.9
    quiet = secrets.scan([t.replace(key, "some/more/words") for t, key in middle], net)
    assert np.mean([bool(every) for _, every in quiet]) < 0.1


def test_quality_ranks_held_out_documents(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert {r["score"] for r in quality.score_documents(odd, labels.where("false")).collect()} == {0.5}
    assert quality.score_documents(odd, labels).count() == odd.count() and quality.score_documents(nothing, labels).count() == 0
    x = np.random.default_rng(0).normal(size=(400, 3))
    r = quality.fit_ranker(x, x[:, 1] + 0.3 * x[:, 0] > 0)
    assert r.weights[1] > 3 * abs(r.weights[0]) and abs((r.score(x) >= 0.5).mean() - 0.5) < 0.05


def test_language_filters(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    got = langid.identify(odd).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 7)} == {"und"}
    assert langid.identify(nothing).count() == 0 and {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    sets = {f"l{k:02}": np.arange(k * 1000, k * 1000 + 400) for k in range(70)}  # more languages than bits of a word
    f = langid.Filters.build(sets)
    for k in (0, 5, 69):
        a, b = f.places(sets[f"l{k:02}"].astype(np.uint32), len(f.slots))
        assert (((f.slots[a, k // 64] & f.slots[b, k // 64]) >> np.uint64(k % 64)) & np.uint64(1)).all()
    assert (f.false_positive < 0.2).all()


def brute_language(sets, text):
    """Counts of n-grams in plain sets; the filters' answer has to agree where it is clear."""
    raw = (" " + " ".join(w for w in re.split(r"[\W\d_]+", text.lower()) if w) + " ").encode()
    found = [int.from_bytes(raw[i : i + 4], "big") for i in range(len(raw) - 3)]
    return {k: sum(g in s for g in found) for k, s in sets.items()}


def test_language_query_against_plain_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "lang", "text").collect()
    tally = collections.defaultdict(collections.Counter)
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            for g in langid.grams(r["text"] or ""):
                tally[r["lang"]].update(g.tolist())
    sets = {k: {g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:3000]} for k, c in tally.items()}
    got = {r["doc_id"]: r for r in queries.op9_langid(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:
        a = got[r["doc_id"]]
        assert a["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert a["lang_pred"] == "und"
            continue
        n = brute_language(sets, r["text"])
        best, second = sorted(n.values())[-1], sorted(n.values())[-2]
        if best > 1.1 * second + 3:
            assert n[a["lang_pred"]] == best
    f = langid.Filters.build({k: np.array(sorted(v)) for k, v in sets.items()})
    assert f.predict("½ ²Ⅷ")[0] == "und" and f.predict("日本語")[1] < 0.5 and f.predict("½ the")[0] != "und"


def test_quality_query_against_a_plain_fit(spark):
    """The registered scores from a plain gradient ascent on the same pairs' likelihood."""
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None}
    known = [d for d in labels if zlib.crc32(str(d).encode()) % 3 != 1 and d in texts]
    x, y = np.array([quality.features(texts[d]) for d in known]), np.array([labels[d] == 1 for d in known])
    z = np.clip((x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0), -8, 8)
    rng = np.random.default_rng(3)
    diff = z[rng.choice(np.flatnonzero(y), 20_000)] - z[rng.choice(np.flatnonzero(~y), 20_000)]
    w = np.zeros(z.shape[1])
    for _ in range(3000):
        w += 0.5 * ((1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))) @ diff / len(diff) - 1e-3 * w)
    got = {r["doc_id"]: r for r in queries.op7_quality(spark, sf).collect()}
    assert len(got) == len(texts) and all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    a, b = z @ w, np.array([got[d]["score"] for d in known])
    b = np.log(np.clip(b, 1e-15, None) / np.clip(1 - b, 1e-15, None))
    assert np.corrcoef(np.argsort(np.argsort(a)), np.argsort(np.argsort(b)))[0, 1] > 0.98


def test_rare_language_has_a_filter(spark):
    rng = random.Random(4)
    docs = [(i, prose(rng, 12), "xx" if i % 300 == 0 else "en") for i in range(4800)]
    docs = [(i, "zwölf grüße über straßen" if lang == "xx" else text, lang) for i, text, lang in docs]
    f = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), sample_rows=8)
    assert f.languages == ("en", "xx") and f.predict("grüße über zwölf straßen")[0] == "xx"


def test_exact_duplicates(odd, nothing):
    rng = random.Random(11)
    for levels in (exact_dedup.LEVEL_BYTES, (1, 3)):
        source = odd if levels != (1, 3) else odd.where("length(text) < 2000 or text is null")
        rows = source.select("doc_id", "text").collect()
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups = collections.defaultdict(list)
        for r in rows:
            groups[norm(r["text"])].append(r["doc_id"])
        got = exact_dedup.exact_duplicates(source, level_bytes=levels).collect()
        assert len(got) == len(rows)
        want = collections.Counter()
        for text, ids in groups.items():
            real = [i for i in ids if i is not None]
            for i in ids:
                want[(i, min(real) if real else None, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
        assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_duplicates(nothing).count() == 0 and rng


def test_tokenizer_pieces_are_exact():
    rng = random.Random(13)
    t = token_output.tokenizer(open(token_output.DEFAULT_VOCABULARY, "rb").read())
    alphabet = ["a", "bc", "Öx", " ", "  ", "\n", " \n", "\t", "'s", "12", "!?", " ", " ", "é", "日本", "."]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert [np.frombuffer(x, t.dtype).tolist() for x in t.encode(texts)] == [t.encoding.encode_ordinary(x) for x in texts]
    assert t.encode([None, ""]) == [b"", b""]


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(token_output.feistel(np.arange(n), n, 5).tolist()) == list(range(n))
    assert token_output.feistel(np.arange(1000), 1000, 1).tolist() != token_output.feistel(np.arange(1000), 1000, 2).tolist()


def test_token_shards_round_trip(spark, odd, nothing, tmp_path):
    docs = odd.select("doc_id", "text")
    path = new_path(spark, "t")
    index = token_output.write_token_shards(docs, path, seq_len=64, rows_per_shard=100).collect()
    n = len(index)
    assert sorted(r["slot"] for r in index) == list(range(n)) and {r["shard"] for r in index} == set(range(-(-n // 100)))
    t = token_output.tokenizer(open(token_output.DEFAULT_VOCABULARY, "rb").read())
    read = list(token_output.read_sequences(path))
    assert [s for s, *_ in read] == list(range(n))
    assert [x[0] for x in token_output.read_sequences(path, n - 7)] == list(range(n - 7, n))
    at = {r["slot"]: r for r in index}
    parts = collections.defaultdict(list)
    for slot, doc, piece, tokens in read:
        assert (at[slot]["doc_id"], at[slot]["piece"], at[slot]["n_tokens"]) == (doc, piece, len(tokens)) and zlib.crc32(tokens.tobytes()) == at[slot]["token_crc32"]
        parts[(doc, piece)].append(tokens.tolist())
    want = collections.defaultdict(list)
    for r in docs.collect():
        ids = t.encoding.encode_ordinary(r["text"] or "") + [50256]
        for k in range(0, len(ids), 64):
            want[(r["doc_id"], k // 64)].append(ids[k : k + 64])
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    fs, root = filesystem(path)
    assert fs.get_file_info(f"{root}/shards/00000000.bin").size == 100 * (16 + 128)
    assert token_output.write_token_shards(nothing).count() == 0


def test_crc_split(spark):
    rows = spark.range(200).select("id", crc_mod(F.col("id"), 3).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in rows)


def test_bitmap_clears_no_listed_key(spark):
    rng = np.random.default_rng(3)
    some = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 500)] + [0, -1, 63, -(2**63)]
    others = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 5000)]
    keys, table = spark.createDataFrame([(x,) for x in some], "k1 long"), spark.createDataFrame([(x,) for x in some + others], "k1 long")
    for bits in (64, 1 << 12, 1 << 25):
        passed = {r["k1"] for r in table.where(simhash.maybe_among(keys, "k1", bits)(F.col("k1"))).collect()}
        low = {x & (bits - 1) for x in some}
        assert passed == {x for x in some + others if x & (bits - 1) in low}
    assert table.where(simhash.maybe_among(keys.limit(0), "k1")(F.col("k1"))).count() == 0
