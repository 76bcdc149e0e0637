"""The other training-data operators: against libraries, brute force and exact round trips, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ferrule.llm import bpe, jpeg, mixing, quality, ring, suffix, unigram, url_filter
from ferrule.llm.queries import rank_file

#: Odd rows for all: nulls anywhere, empty and blank texts, repeated rows, one long text, names that clash with inner ones.
SCHEMA = "doc_id long, text string, source string, id string, size int, h long, spans string"
LONG = "lorem ipsum dolor " * 20_000
ROWS = [(1, None, "a", "x", 1, 1, ""), (2, "", None, None, None, None, None), (3, " \t\n", "a", "x", 1, 1, ""), (3, "repeated row of text", "b", "x", 1, 1, ""), (3, "repeated row of text", "b", "x", 1, 1, ""), (None, "no id é ü 漢字 🙂 \x00   ﷽", "b", "x", 1, 1, ""), (9, LONG, None, "x", 1, 1, "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(n=300, seed=3):
    r = random.Random(seed)
    kinds = ["abcab", " ", "  \n", "ÄÖü", "漢字かな", "0123", "!?,.", "'s 'll", "\r\n\t", "　", "🙂👩‍👧", "aaaaaaaa", "=-=-", "the and ing"]
    return ["".join(r.choice(kinds)[: r.randint(1, 8)] for _ in range(r.randint(0, 60))) for _ in range(n)] + ["a" * 5000, "=" * 3000, " " * 2000, "ab" * 1500, "", "漢" * 700]


def test_bpe_is_the_librarys():
    import tiktoken

    path, pattern = rank_file()
    ranks = bpe.load_ranks(path)
    want, own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.Bpe(ranks, pattern)
    split = bpe.chunker(pattern)
    for t in texts():
        ids = want.encode_ordinary(t)
        assert own.encode(t) == ids
        assert [i for c in split(t) for i in own.encode(c)] == ids
        assert own.decode(ids) == t.encode()


def test_bpe_rows(odd, none):
    got = bpe.encode_documents(odd, *rank_file()).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in got) == sorted((d or 0, (t or "").encode()) for d, t, *_ in ROWS)
    assert all(r.n_tokens == len(r.token_ids.split()) for r in got)
    digests = {(r.doc_id, r.n_tokens): r.decoded_sha256 for r in bpe.digest_documents(odd, *rank_file()).collect()}
    assert digests[(9, next(r.n_tokens for r in got if r.doc_id == 9))] == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.digest_documents(none, *rank_file()).collect() == []


def test_unigram_is_the_librarys(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = unigram.load_pieces(path)
    own = unigram.UnigramCounter(pieces)
    vocab = [("<unk>", 0.0), *((f"<0x{i:02X}>", min(pieces.values())) for i in range(256)), *pieces.items()]
    lowest = min(pieces.values())
    assert own.unk == lowest - unigram.UNK_PENALTY
    want = Tokenizer(models.Unigram([("<unk>", lowest), *vocab[1:]], 0, True))
    for t in [x for x in texts(120) if len(x) < 400 and not any(c in x for c in "<>")]:
        if t:
            assert own.count(t) == len(want.encode((" " + t).replace(" ", unigram.SPACE)).ids), t
    got = unigram.count_tokens(odd, path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got if r.doc_id in (1, 2)) == [(1, 0), (2, 0)] and len(got) == len(ROWS)
    assert unigram.count_tokens(none, path).collect() == []


def test_jpeg_round_trip(odd, none):
    r = random.Random(1)
    for n in (64, 128, 64 * 300):
        data = bytes(r.randrange(256) for _ in range(n))
        ((width, height, plane),) = jpeg.decode(jpeg.encode(data))
        assert (width, height, plane.tobytes()) == (512, n // 64 * 8, data)
    high = bytes(range(256)) * (64 * (jpeg.MOST_ROWS + 5) // 256)
    assert b"".join(p.tobytes() for *_, p in jpeg.decode(jpeg.encode(high))) == high
    rows = jpeg.media_columns(odd).collect()
    for x in rows:
        text = next((t or "").encode() for d, t, *_ in ROWS if d == x.doc_id and len((t or "").encode()) == x.n_bytes)
        padded = text + b"\0" * (max(1, -(-len(text) // 64)) * 64 - len(text))
        assert x.payload_sha256 == hashlib.sha256(padded).hexdigest() and x.payload_bytes == len(padded) and x.error is None
    assert len(rows) == len(ROWS) and jpeg.media_columns(none).collect() == []


def test_jpeg_faults_are_rows(spark):
    good = jpeg.encode(bytes(64))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:40])), (3, bytearray(b"no image")), (4, bytearray()), (5, None)], "doc_id long, media binary")
    got = {r.doc_id: r for r in jpeg.media_features(df).collect()}
    assert got[1].error is None and all(got[i].error and got[i].payload_sha256 is None for i in (2, 3, 4, 5))


def test_jpeg_of_another_encoder():
    """A grey 16 x 8 image of 2 blocks, 128 and 136, with AC terms that the thumbnail leaves out, coded block by block."""
    dc, ac = (bytes([0, 2] + [0] * 14), b"\x00\x05"), (bytes([0, 2] + [0] * 14), b"\x00\x01")
    bits = "00" + "00" + "01" + "10000" + "01" + "1" + "00"
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    data = b"\xff\xd8" + jpeg.segment(0xDB, b"\0" + bytes([4]) * 64) + jpeg.segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + jpeg.segment(0xC4, b"\0" + dc[0] + dc[1] + b"\x10" + ac[0] + ac[1]) + jpeg.segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    ((width, height, plane),) = jpeg.decode(data)
    assert (width, height, plane.tolist()) == (16, 8, [[128, 136]])


def test_suffix_order_and_repeats():
    r = random.Random(2)
    for n in (0, 1, 2, 30, 200):
        for alphabet in (b"a", b"ab", b"abcz"):
            t = bytes(r.choice(alphabet) for _ in range(n))
            assert suffix.suffix_array(t) == sorted(range(n), key=lambda i: t[i:])
    t = b"xxabcdefyyabcdefzz"
    assert [t[a:b] for a, b in suffix.repeats(t, 5)] == [b"abcdef", b"abcdef"]


def test_suffix_rows_against_brute_force(spark, odd, none):
    r = random.Random(4)
    passage = ["".join(r.choices("abcdefghij klm", k=k)) for k in (199, 200, 260, 700)]
    docs = ["".join(r.choice([*passage, "".join(r.choices("nopqrstuv wxyz", k=r.randint(1, 150))), "é" * r.randint(1, 130)]) for _ in range(r.randint(0, 7))) for _ in range(40)]
    seen: dict[bytes, int] = {}
    raw = [d.encode() for d in docs]
    for b in raw:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    want = {}
    for n, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        rest = bytes(c for c, g in zip(b, gone) if not g)
        want[n] = (len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(rest).hexdigest())
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.repeat_digests(df).collect()} == want
    got = suffix.repeat_digests(odd).collect()
    assert sorted((x.doc_id or 0, x.n_removed) for x in got if x.doc_id != 9) == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 0), (3, 0)]
    assert [x.n_removed for x in got if x.doc_id == 9] == [len(LONG)]
    assert suffix.repeat_digests(none).collect() == []


def test_ring_balance_and_odd_rows(spark, odd, none):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = ring.assign(df, 24).collect()
    counts = [sum(r.shard == s for r in rows) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and len(rows) == 5000
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    more = {r.doc_id: r.shard for r in ring.assign(df, 25).collect()}
    moved = sum(more[r.doc_id] != r.shard for r in rows)
    assert moved < 0.35 * 5000  # dealing by remainder would move 96 %
    got = ring.assign(odd, 3).collect()
    assert len(got) == len(ROWS) and sorted(sum(r.shard == s for r in got) for s in range(3)) == [2, 2, 3]
    assert ring.assign(none).collect() == []


def test_mixing_and_quality_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r.size for r in got) and all(r.taken == 0 for r in got if r.size == 0)
    by = {r.source: (r.target, r.source_size) for r in got}
    for s, (target, size) in by.items():
        assert abs(sum(r.taken for r in got if r.source == s) - target) <= 1 and target <= 2 * size
    assert mixing.mix(none).collect() == []
    verdicts = quality.quality(odd).collect()
    assert len(verdicts) == len(ROWS) and all(r.base_failed and not r.kept for r in verdicts)
    assert quality.quality(none).collect() == [] and quality.cleaned(none).collect() == []


def test_lines_of_many_documents_go(spark):
    r = random.Random(6)
    body = lambda: "\n".join(" ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(9)) for _ in range(4))
    rows = [(i, body() + "\nAll rights: reserved 2024", "host") for i in range(120)] + [(500 + i, "Menu about " + " home contact" * 9 + "\n" + "short words here", "host") for i in range(60)] + [(900, body() + "\nAll rights: reserved 2024", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {x.doc_id: x.text for x in quality.cleaned(df).collect()}
    assert "reserved" not in out[0] and out[0].count("\n") == 3 and "reserved" in out[900]
    assert set(out) == {*range(120), 900}


HELD_OUT = [
    ("cheap-viagra.example.net", "/order/discount-pills", 1), ("slots-casino.example.org", "/free-bonus", 1), ("news.example.net", "/xxx/free-porn-video", 1), ("fake-rolex.example.com", "/replica/watches", 1),
    ("loans-today.example.org", "/instant-payday-cash", 1), ("adult-chat.city.info", "/sex/live", 1), ("warez-download.example.com", "/crack/keygen", 1), ("prize-claim.example.net", "/win-free-iphone", 1),
    ("forum.travel.example.com", "/profile/casino-bonus", 1), ("www.museum.example.org", "/user/cheap-pills-online", 1), ("poker-bet.example.com", "/online-casino", 1), ("buy-links.example.org", "/seo/free-backlinks", 1),
    ("library.city.info", "/catalogue/maps", 0), ("weather.example.org", "/forecast/madrid", 0), ("www.school.example.com", "/lectures/history", 0), ("garden.example.org", "/en/roses-and-tulips", 0),
    ("recipes.example.net", "/bread/sourdough", 0), ("travel.example.org", "/2020/mountain-route", 0), ("docs.software.example.com", "/manual/install.html", 0), ("theatre.example.net", "/programme/spring", 0),
    ("physics.university.example.org", "/papers/week5.pdf", 0), ("birds.city.info", "/species/heron", 0), ("music.school.example.net", "/concerts/timetable", 0), ("radio.example.org", "/fr/programme/heure", 0),
]


def test_urls_held_out(spark):
    assert not {(h, p) for h, p, _ in HELD_OUT} & {(h, p) for h, p, _ in url_filter.LABELLED}
    rows = [(i, f"http://{h}{p}?q#x", "y") for i, (h, p, _) in enumerate(HELD_OUT)]
    rows += [(50, None, "y"), (51, "no scheme", ""), (52, "ftp://WWW.Example.COM/en/x", ""), (53, "http://a.example.com/en/", ""), (54, "http://net/es/", ""), (55, "://", ""), (56, "http://x.org/" + "long/" * 20_000, ""), (50, None, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df, rules=()).collect()}
    right = [(got[i].verdict == "block") == bool(y) for i, (*_, y) in enumerate(HELD_OUT)]
    assert sum(right) >= 0.8 * len(right) and sum(got[i].verdict == "block" for i, (*_, y) in enumerate(HELD_OUT) if not y) == 0
    for only in (0, 1):  # host and path both carry signal: where the other is missing, spam still scores above the rest
        part = spark.createDataFrame([(i, f"http://{h if only == 0 else ''}{p if only else ''}") for i, (h, p, _) in enumerate(HELD_OUT)], "page_id long, url string")
        score = {r.page_id: r.score for r in url_filter.judge(part, rules=()).collect()}
        mean = lambda y: sum(score[i] for i, x in enumerate(HELD_OUT) if x[2] == y) / 12  # noqa: B023, E731
        assert mean(1) > mean(0)
    assert got[50].verdict == got[55].verdict == "allow" and got[50].score == 0
    ruled = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert ruled[52] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert ruled[53] == ("a.example.com", "/en/", "example.com/en/", "block") and ruled[54] == ("net", "/es/", "net/es/", "block")
    assert ruled[50][:3] == ruled[51][:3] == ("", "", None) and ruled[55][:2] == ("", "")
    assert url_filter.judge(df.limit(0)).collect() == [] and url_filter.judge(df).count() == len(rows)


def test_ring_against_a_walk_row_by_row(spark):
    df = spark.range(700).select(F.when(F.col("id") % 7 > 0, F.col("id") % 400).alias("doc_id"), F.when(F.col("id") % 5 > 0, F.lit("t")).alias("text"))
    rows = df.select(F.col("doc_id"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"))
    rows = [tuple(r) for r in rows.select((F.xxhash64(F.col("doc_id").alias("id"), F.col("crc"), F.col("size"))).alias("place"), "doc_id", "crc", "size").collect()]
    shards = 5
    node, total = ring.nodes(shards), len(rows)
    room, used, want = [total // shards + (s < total % shards) for s in range(shards)], Counter(), Counter()
    unsigned = lambda x: x & (2**64 - 1)
    cells = {}
    for r in sorted(rows, key=lambda r: (unsigned(r[0]) >> (64 - ring.CELL_BITS), r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        cells.setdefault(unsigned(r[0]) >> (64 - ring.CELL_BITS), []).append(r)
    runs = [[cell, found] for cell, found in sorted(cells.items())]
    while runs:
        for run in runs:
            while node[run[0]] < 0 or not room[node[run[0]]]:
                run[0] = (run[0] + 1) % ring.CELLS
            shard = node[run[0]]
            while run[1] and room[shard]:
                r = run[1].pop(0)
                want[r[1], r[3], r[2], shard, used[shard]] += 1
                used[shard], room[shard] = used[shard] + 1, room[shard] - 1
        runs = [run for run in runs if run[1]]
    got = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in ring.assign(df, shards).collect())
    assert got == want


def test_equal_rows_are_dealt_in_blocks(spark):
    df = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    rows = ring.assign(df, 4).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert sorted((r.n, r.d, r.m) for r in rows) == [(7500, 7500, 7499)] * 4
    got = mixing.mix(df).agg(F.sum("taken").alias("t"), F.min("taken").alias("low"), F.max("taken").alias("high"), F.count("*").alias("n")).first()
    assert (got.t, got.low, got.high, got.n) == (90_000, 2, 4, 30_000)


def long_texts():
    r = random.Random(21)
    return ["".join(r.choice(["thand ", "keit", "queñci. ", "\n", "漢字", "2024-", "  "]) for _ in range(9000)), "a" * 40_000, ("word " * 4000).strip(), "x" * 300 + " " + "y=" * 5000]


def test_long_texts_in_both_tokenizers(spark):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer, models

    texts_ = long_texts()
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    path, pattern = rank_file()
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in bpe.digest_documents(df, path, pattern).collect()}
    for i, t in enumerate(texts_):
        ids = want.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = unigram.load_pieces(path)
    lowest = min(pieces.values())
    library = Tokenizer(models.Unigram([("<unk>", lowest), *((f"<0x{i:02X}>", lowest) for i in range(256)), *pieces.items()], 0, True))
    counts = {r.doc_id: r.n_tokens for r in unigram.count_tokens(df, path).collect()}
    for i, t in enumerate(texts_):
        assert counts[i] == len(library.encode((" " + t).replace(" ", unigram.SPACE)).ids), i


def test_queries_on_whole_rows(spark, sf_dir):
    """op6's and op10's digests as the queries return them, against the library and the text itself."""
    import tiktoken

    from ferrule.llm import queries

    texts_ = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    path, pattern = rank_file()
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for r in queries.op10_bpe(spark, sf_dir).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want.encode_ordinary(texts_[r.doc_id]))).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts_[r.doc_id].encode()).hexdigest()
    for r in queries.op6_jpeg(spark, sf_dir).collect():
        raw = texts_[r.doc_id].encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        media = jpeg.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        plane = [payload[i : i + 64] for i in range(0, len(payload), 64)]
        cells, mean = [], sum(payload) / len(payload)
        for i in range(8):
            for j in range(8):
                cell = [b for row in plane[len(plane) * i // 8 : len(plane) * (i + 1) // 8] for b in row[8 * j : 8 * j + 8]]
                cells.append(bool(cell) and sum(cell) / len(cell) > mean + 1e-9)
        assert r.feature.split("ahash=")[1] == f"{int(''.join(map(str, map(int, cells))), 2):016x}"
