"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import collections
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from cellspark.llm import bpe, dart, decontam, licenses, lines, neardup, quality, shards, tokens, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = P.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))


def docs(spark, *rows):
    return spark.createDataFrame([(k, t, "en", s, 0) for k, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, an empty and a long text, a repeated row, columns that operators could use themselves."""
    rows = [(1, None, "a"), (2, "", None), (None, "one two three", "a"), (3, LONG, "b"), (4, "x y z", "b"), (4, "x y z", "b"), (None, None, None)]
    return docs(spark, *rows).withColumns({c: F.lit(1) for c in ("k", "t", "h", "n", "ids", "words", "matches", "doc", "host", "gone", "lines", "place", "n_removed", "kept")})


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark).limit(0)


def test_tokens(spark, odd, none):
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens > 0) for r in tokens.token_counts(odd, P.path("word_bpe_49k.json")).collect())
    assert got[4, 5, True] == 2 and got[1, 0, False] == 1 and got[None, 0, False] == 1 and got[3, len(LONG), True] == 1
    assert tokens.token_counts(none, P.path("word_bpe_49k.json")).collect() == []


def test_tokens_special_strings_and_unicode(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    samples = ["<|endoftext|>a<|startoftext|> b", "it's 12 ½ İ ΑΣ Σ \x85 \x1c! ", "日本語、テスト。" * 50, "!\x1c!", "a" * 5000]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs(spark, *((i, s, "") for i, s in enumerate(samples))), P.path("word_bpe_49k.json")).collect()}
    assert got == {i: len(tok.encode(s, add_special_tokens=False).ids) for i, s in enumerate(samples)}


def test_bpe_round_trip(spark, odd, none):
    got = bpe.round_trip(odd, RANKS, P.PATTERN, keep=["doc_id", "text"]).collect()
    assert len(got) == 7 and all(bytes(r.decoded).decode() == (r.text or "") for r in got)
    again = bpe.decode_ids(bpe.encode_texts(odd.drop("ids"), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in again)
    assert bpe.round_trip(none, RANKS, P.PATTERN, keep=["doc_id"]).collect() == []


@pytest.mark.parametrize("text", [LONG, "a" * 250_000, "日本語、テスト。" * 30_000, "word, it's  \n\n x\x1cy\x85z \t" * 12_000])
def test_bpe_pieces_are_safe(text):
    enc = bpe.encoding(open(RANKS, "rb").read(), P.PATTERN)
    assert "".join(bpe.safe_pieces(text)) == text
    assert bpe.encode(enc, text).tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize("white", [" ", "\n", "\r\n", "\u00a0", " \t"])
@pytest.mark.parametrize("end", ["", "x", " y"])
def test_bpe_of_long_white_space(white, end):
    """As the library on runs that it can do; runs that it can't are one pre-token."""
    enc = bpe.encoding(open(RANKS, "rb").read(), P.PATTERN)
    for n in (30_000, 120_000):
        text = f"a, {'b ' * 60_000}{white * n}{end}\x1c{white * n}c"
        assert bpe.encode(enc, text).tolist() == enc.encode_ordinary(text)
    text = "a" + white * (2_000_000 // len(white)) + end
    assert enc.decode_bytes(bpe.encode(enc, text).tolist()).decode() == text


def test_bpe_replaces_columns_of_its_names(spark):
    at = docs(spark, (1, "one two", "s")).select("doc_id", "text", F.lit(9).alias("ids"), F.lit(9).alias("decoded"), F.lit(9).alias("a.b"))
    row = bpe.round_trip(at, RANKS, P.PATTERN).first()
    assert bytes(row.decoded) == b"one two" and len(row.ids) == 2 and row["a.b"] == 9


def test_quality(spark, odd, none):
    got = {(r.doc_id, r.n_words): r.kept for r in quality.quality_report(odd).collect()}
    assert got[1, 0] is False and got[3, 120_000] is False and got[None, 3] is False  # the long text repeats itself
    assert quality.quality_report(none).collect() == []
    clean = " ".join(f"w{i}" for i in range(60))
    assert quality.quality_filter(docs(spark, (1, clean, None), (1, clean, None), (2, "short", "a"))).columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert quality.quality_filter(docs(spark, (1, clean, None), (1, clean, None), (2, "short", "a"))).count() == 2


def test_quality_counts_repeated_windows(spark):
    r = quality.quality_report(docs(spark, (1, "a b c a b c\n# x\n# x\n", "s"))).first()
    assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.n_symbols, r.word_chars) == (10, 6, 1, 2, 10)


def test_quality_rejects_a_bad_host(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad " * 3, "bad") for i in range(400)] + [(1000, clean, "bad"), (1001, clean, "lone")] + [(2000 + i, f"{clean} v{i}", "good") for i in range(400)]
    got = {r.doc_id: r.kept for r in quality.quality_report(docs(spark, *rows)).collect()}
    assert got[1000] is False and got[1001] is True and all(got[2000 + i] for i in range(400))


def test_lines(spark, odd, none):
    out = lines.dedup_lines(odd).select("doc.*")
    assert out.columns == odd.columns and out.count() == 7
    assert {r.text for r in out.where("doc_id IS NULL").collect()} == {None, "one two three"}
    assert lines.dedup_lines(none).collect() == []


@pytest.mark.parametrize(
    ("given", "left"),
    [
        (["a\nb\nc", "x\na\nb\nc\ny"], ["a\nb\nc", "x\ny"]),
        (["a\na\na\na"], ["a"]),
        (["a\n\nb\nc\nd", "a\nb\n \nc"], ["a\n\nb\nc\nd", " "]),
        (["a\nb", "a\nb"], ["a\nb", "a\nb"]),
        (["a\nb\nc\nd", "b\nc\nd\ne", "c\nd\ne"], ["a\nb\nc\nd", "e", ""]),
    ],
)
def test_lines_cases(spark, given, left):
    got = lines.dedup_lines(docs(spark, *((i, t, "s") for i, t in enumerate(given)))).select("doc.doc_id", "doc.text").orderBy("doc_id").collect()
    assert [r.text for r in got] == left


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_decontamination(spark, odd, none):
    bench = items(spark, (7, "word5 TAIL5, word6"), (8, None), (None, "one two three"), (7, "word5 tail5 word6"))
    got = {(r.doc_id, r.n_words): r for r in decontam.report(decontam.find_matches(odd, bench, ["doc_id"])).collect()}
    assert got[3, 120_000].n_items == 1 and got[3, 120_000].items_sha256 == hashlib.sha256(b"7").hexdigest()
    assert got[None, 3].contaminated and got[4, 3].n_hit == 0 and got[1, 0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontam.decontaminate(odd, bench).columns == odd.columns and decontam.decontaminate(odd, bench).count() == 5
    assert decontam.find_matches(none, bench, ["doc_id"]).collect() == []
    assert decontam.decontaminate(odd, bench.limit(0)).count() == 7


def test_decontamination_finds_the_longest_match_in_blocks(spark):
    item = " ".join(f"i{n}" for n in range(30))
    text = f"a b {' '.join(f'i{n}' for n in range(5, 20))} c {' '.join(f'i{n}' for n in range(9))} {item}"
    found = decontam.find_matches(docs(spark, (1, text, "s")), items(spark, (1, item), (2, "c i0 i1")), ["doc_id"], block_bytes=40).first()
    assert sorted(tuple(m) for m in found.matches) == [("1", 0, 27, 30, 27, 30), ("1", 5, 2, 15, 2, 15), ("2", 0, 17, 3, 17, 3)]


def test_decontamination_of_repeated_words_in_bounded_memory(spark):
    import resource

    test = decontam.TestSuffixes.of([("1", "same " * 2000), ("2", "same same other " * 300)], decontam.WINDOW)
    text = "head " + "same " * 200_000 + "tail " + "same same other " * 2000
    soft, hard = resource.getrlimit(resource.RLIMIT_AS)
    size = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize()
    resource.setrlimit(resource.RLIMIT_AS, (size + (1 << 30), hard))
    try:
        counts, found = decontam.shard_matches([text], test)
    finally:
        resource.setrlimit(resource.RLIMIT_AS, (soft, hard))
    assert counts == [206_002]
    assert sorted(found[0]) == [("1", 0, 1, 2000, 1, 200_000), ("2", 0, 200_002, 900, 200_002, 6000)]
    row = decontam.report(decontam.find_matches(docs(spark, (1, text, "s")), items(spark, (1, "same " * 2000)), ["doc_id"])).first()
    assert (row.n_hit, row.n_items) == (200_000, 1)


def test_decontamination_matches_brute_force():
    """Few words, so that matches overlap and repeat."""
    rng = np.random.default_rng(4)
    for pairs in (decontam.PAIRS, 7):
        held, decontam.PAIRS = decontam.PAIRS, pairs
        for _ in range(30):
            own = [rng.choice(["a", "b"], rng.integers(0, 40), p=[0.7, 0.3]).tolist() for _ in range(3)]
            texts = [rng.choice(["a", "b", "c"], rng.integers(0, 60), p=[0.6, 0.35, 0.05]).tolist() for _ in range(4)]
            test = decontam.TestSuffixes.of([(str(i), " ".join(x)) for i, x in enumerate(own)], 5)
            counts, found = decontam.shard_matches([" ".join(x) for x in texts], test)
            assert counts == [len(x) for x in texts]
            for d, text in enumerate(texts):
                hits = collections.defaultdict(set)
                longest = collections.Counter()
                for i, item in enumerate(own):
                    n = min(5, len(item))
                    for k in range(len(item) - n + 1 if n else 0):
                        for p in range(len(text) - n + 1):
                            if text[p : p + n] == item[k : k + n]:
                                hits[str(i)] |= set(range(p, p + n))
                                m = n
                                while p + m < len(text) and k + m < len(item) and text[p + m] == item[k + m]:
                                    m += 1
                                longest[str(i)] = max(longest[str(i)], m)
                got = collections.defaultdict(set)
                for name, k, p, n, start, size in found[d]:
                    assert own[int(name)][k : k + n] == text[p : p + n] and start <= p and p + n <= start + size
                    got[name] |= set(range(start, start + size))
                assert got == hits
                assert all(max(x[3] for x in found[d] if x[0] == name) == longest[name] for name in hits)
        decontam.PAIRS = held


def test_suffix_array_orders_suffixes():
    ids = np.array([*np.random.default_rng(1).integers(1, 4, 200), 0, 0], np.int32)
    order = decontam.suffix_array(ids, np.arange(200), 256)
    assert [ids[i:].tolist() for i in order] == sorted(ids[i:].tolist() for i in range(200))


def test_near_duplicates(spark, odd, none):
    got = collections.Counter((r.k, r.class_id) for r in neardup.near_duplicates(odd).collect())
    assert got == {(1, 1): 1, (2, 1): 1, (None, 1): 1, (None, None): 1, (3, 3): 1, (4, 4): 2}
    left = neardup.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert collections.Counter(r.doc_id for r in left.collect()) == {1: 1, 3: 1, 4: 1, None: 1}
    assert neardup.near_duplicates(none).collect() == [] and neardup.drop_near_duplicates(none).collect() == []


def test_one_document_of_each_class_stays(spark):
    """Near texts of one id, repeated rows of the text that stays, and a class without ids."""
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, "s"), (1, f"{text} end", "s"), (1, text, "s"), (None, "a b c", "s"), (None, "A b, c", "s"), (2, "", "s"), (2, None, "t")]
    left = neardup.drop_near_duplicates(docs(spark, *rows)).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "2", "None"]
    kept = [r.stays for r in neardup.near_duplicates(docs(spark, *rows)).collect()]
    assert len(kept) == 7 and sum(kept) in (4, 5)  # a repeated row stays with the row that it repeats


def test_near_duplicates_of_a_group_around_one_text(spark):
    """Copies of one text, each changed elsewhere: near the text, not always near each other."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base), "s")]
    for i in range(60):
        own = base.copy()
        for j in rng.choice(200, 4, replace=False):
            own[j] = f"x{i}x{j}"
        rows.append((i, " ".join(own), "s"))
    rows.append((2000, " ".join(f"v{i}" for i in range(200)), "s"))
    got = {r.k: r.class_id for r in neardup.near_duplicates(docs(spark, *rows)).collect()}
    from test_llm_queries import classes

    assert got == classes({k: t for k, t, _ in rows})


def test_near_duplicates_without_their_origin(spark):
    """Copies of a text that is not there, changed more or less: leaders leave pairs open, differences settle them."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        own = [f"w{j}" for j in range(200)]
        for j in rng.choice(200, 1 + i % 6, replace=False):
            own[j] = f"x{i}x{j}"
        rows.append((i, " ".join(own), "s"))
    settled, join = [], neardup._settled
    neardup._settled = lambda *a: settled.append(1) or join(*a)
    try:
        got = {r.k: r.class_id for r in neardup.near_duplicates(docs(spark, *rows)).collect()}
    finally:
        neardup._settled = join
    from test_llm_queries import classes

    assert settled and got == classes({k: t for k, t, _ in rows})


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    e = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    got = dart.signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.array([300, 300]), 4096)
    assert abs((got[0] == got[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    one = dart.signatures(e[:1], np.array([1.0]), np.array([1]), 112)
    assert len(set(one[0].tolist())) == 112


def test_packed_signatures_count_agreement(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, (1, neardup.COORDINATES)).astype(np.uint64)
    for same, result in ((neardup.AGREE, True), (neardup.AGREE - 1, False)):
        b = a.copy()
        b[0, same:] ^= np.uint64(1)
        row = spark.createDataFrame([(neardup.packed(a)[0].tolist(), neardup.packed(b)[0].tolist())], "a array<long>, b array<long>")
        assert row.select(neardup.agrees(F.col("a"), F.col("b")).alias("x")).first().x is result


def test_shards(spark, odd, none, tmp_path):
    layout = shards.write_shards(odd, f"{tmp_path}/s", RANKS, P.PATTERN, 64, 50256, 5, 1 << 16)
    assert layout.shards > 2 and layout.width == 2
    got = shards.read_shards(spark, f"{tmp_path}/s", layout).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) == list(range(layout.size))
    assert collections.Counter(r.doc_id for r in got if r.doc_id != 3) == {1: 1, 2: 1, None: 2, 4: 2}
    whole = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == 3), key=lambda r: r.part))
    enc = bpe.encoding(open(RANKS, "rb").read(), P.PATTERN)
    assert enc.decode_bytes(np.frombuffer(whole, "<u2")[:-1].tolist()).decode() == LONG
    for first, count in ((10, 25), (0, 1), (layout.size - 1, None), (layout.rows - 1, 2), (layout.size, None)):
        some = shards.read_shards(spark, f"{tmp_path}/s", layout, first, count).collect()
        last = layout.size if count is None else first + count
        assert sorted((r.slot, bytes(r.ids)) for r in some) == sorted((r.slot, bytes(r.ids)) for r in got if first <= r.slot < last)
    # A reader without Spark finds a slot's record by seeking.
    row = max(got, key=lambda r: r.slot)
    shard, byte = layout.locate(row.slot)
    (file,) = (tmp_path / f"s/shard={shard}").glob("part-*")
    with open(file, "rb") as f:
        f.seek(byte + shards.HEAD_BYTES)
        assert f.read(2 * row.n_tokens) == bytes(row.ids)
    assert shards.write_shards(none, f"{tmp_path}/none", RANKS, P.PATTERN, 64, 50256, 5, 1 << 16).size == 0
    assert shards.read_shards(spark, f"{tmp_path}/none", shards.Layout(64, 50256, 5, 0, 2, 9)).collect() == []


def test_shards_of_large_ids(spark, tmp_path):
    ranks = tmp_path / "ranks"
    lines_ = open(RANKS, "rb").read().splitlines()
    ranks.write_bytes(b"\n".join(x.split()[0] + b" " + str(int(x.split()[1]) + 40_000).encode() for x in lines_))
    text = "some words and more"
    layout = shards.write_shards(docs(spark, (1, text, "s")), f"{tmp_path}/s", str(ranks), P.PATTERN, 8, 39_999, 5, 1 << 16)
    (row,) = shards.read_shards(spark, f"{tmp_path}/s", layout).collect()
    enc = bpe.encoding(ranks.read_bytes(), P.PATTERN)
    assert layout.width == 4 and np.frombuffer(bytes(row.ids), "<u4").tolist() == [*enc.encode_ordinary(text), 39_999]


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutation(n):
    assert sorted(shards.permute(np.arange(n), n, 9).tolist()) == list(range(n))


def test_warc(spark, tmp_path):
    gap = "\r\n\r\n"
    html = ["<p>", None, "", f"a{gap}WARC/1.1\r\nx: y{gap}", "abc\r\n", f"{gap}{gap}", "<p>", "é\u0000\n", "<p>", "tail\r\n\r"]
    pages = spark.createDataFrame([(i if i != 8 else None, f"http://h{i}/a b\r\n?q#f" if i % 2 else None, h, 5) for i, h in enumerate(html)], "page_id long, url string, html string, seq int")
    warc.write_captures(pages, f"{tmp_path}/w")
    captures = warc.assemble(warc.read_records(spark, f"{tmp_path}/w"))
    got = captures.collect()
    assert len(got) == len(html) and all(len(r.requests) == len(r.metadata) == 1 for r in got)
    plain = {r.page_id: r for r in warc.digest_rows(captures).collect()}
    assert {k: r.refers_to for k, r in plain.items() if r.record_type == "revisit"} == {2: 1, 6: 0, None: 0}
    assert {k: r.payload_bytes for k, r in plain.items()} == {(i if i != 8 else None): len((h or "").encode()) for i, h in enumerate(html)}
    bodies = {bytes(r.response.payload).decode() for r in got if r.response.type == "response"}
    assert bodies == {h or "" for h in html}
    warc.write_captures(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_records(spark, f"{tmp_path}/none").count() == 0


def test_warc_small_payloads_and_repeated_rows(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb"), (3, "u", "bbbb")], "page_id long, url string, html string")
    warc.write_captures(pages, f"{tmp_path}/w", revisit_bytes=3)
    got = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in warc.digest_rows(warc.assemble(warc.read_records(spark, f"{tmp_path}/w"))).collect())
    assert got == {(1, "response", None): 1, (2, "response", None): 1, (3, "response", None): 2, (4, "revisit", 3): 1}


def archive(*records):
    """A WARC file of (type, id, ids named, block)."""
    out = ""
    for kind, own, named, block in records:
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", *(f"WARC-Concurrent-To: {x}" for x in named), f"Content-Length: {len(block)}"]
        out += "\r\n".join(head) + "\r\n\r\n" + block + "\r\n\r\n"
    return out.encode()


def test_warc_follows_every_concurrent_id(spark, tmp_path):
    records = [
        ("metadata", "m1", ["a"], "one"),
        ("response", "a", ["q1"], "A"),
        ("request", "q1", [], "?"),
        ("request", "q2", ["zzz", "a"], "??"),
        ("metadata", "m2", ["q2"], "two"),  # names a request alone
        ("metadata", "m3", ["m2"], "three"),
        ("response", "b", [], "B"),
        ("request", "q3", ["a", "b"], "both"),
        ("revisit", "c", [], ""),
        ("metadata", "m4", ["lost"], "no capture"),
        ("warcinfo", "i", ["a"], "info"),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/x.warc").write_bytes(archive(*records[:5]))
    (tmp_path / "w/y.warc").write_bytes(archive(*records[5:]))
    read = warc.read_records(spark, f"{tmp_path}/w")
    got = {r.response.record_id: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in warc.assemble(read).collect()}
    assert got == {"a": (["q1", "q2", "q3"], ["m1", "m2", "m3"]), "b": (["q3"], []), "c": ([], [])}
    assert warc.assemble(read).count() == 3
    assert {r.record_id: r.concurrent_to for r in read.collect()}["q2"] == ["zzz", "a"]


def test_warc_rejects_a_cut_archive():
    parser = warc.Parser()
    assert list(parser.feed(b"WARC/1.1\r\nContent-Length: 9")) == [] and list(parser.feed(b"abc")) == []
    with pytest.raises(ValueError):
        list(parser.end())


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/x?y"), (4, "x://example.org"), (5, "http://h.com/fr/a#b"), (None, "http://com/de/"), (5, "http://h.com/fr/a#b"), (6, "http://notexample.org?x/"), (7, "ftp://a://b/c")]
    pages = spark.createDataFrame([(k, u, None) for k, u in rows], "page_id long, url string, html string").withColumn("tokens", F.lit(1))
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.judge_urls(pages).collect()}
    assert got[3, "a.example.org", "/es/x"] == ("example.org/es/", "block") and got[5, "h.com", "/fr/a"] == ("com/fr/", "allow")
    assert got[None, "com", "/de/"] == ("com/de/", "block") and got[4, "example.org", ""][0] is None
    assert got[6, "notexample.org", ""][0] is None and (1, "", "") in got and (2, "", "") in got and (7, "a:", "//b/c") in got
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_segment():
    costs = {"the": 1.0, "ring": 2.0, "there": 9.0, "in": 3.0}
    assert urls.segment("thering", costs, 9.0) == ["the", "ring"]
    assert urls.segment("", costs, 9.0) == [] and "".join(urls.segment("qzx", costs, 9.0)) == "qzx"


def test_urls_whose_tokens_are_rare(spark):
    name = F.translate(F.format_string("%06d", F.col("id")), "0123456789", "abcdefghij")
    seen = spark.range(120_000).select(
        F.col("id").alias("page_id"),
        F.concat(F.when(F.col("id") < 70_000, F.lit("http://h.com/fr/")).otherwise(F.lit("http://h.com/de/")), name).alias("url"),
        F.concat(F.lit("<title>"), name, F.lit("</title>")).alias("html"),
    )
    new = spark.createDataFrame([(-1, "http://h.net/x/bbjjjj", None), (-2, "http://h.net/x/unseen", None), (-3, "http://bbjjjjbbjjji.net/", None)], "page_id long, url string, html string")
    pages = seen.unionByName(new)
    got = {r.page_id: r.score for r in urls.judge_urls(pages).where("page_id < 0").collect()}
    # Token bbjjjj is seen once, with block, and sorts last.
    assert got[-1] < got[-2]
    words, letter = urls.word_costs(pages)
    made = urls.tokenised(new, words, letter).where("k = -3").first()
    assert made.tokens == ["t:net", "h:bbjjjj", "h:bbjjji"]


@pytest.mark.parametrize("sizes", [(3, 100_000), (50_000, 3), (0, 0), (40, 40)])
def test_url_verdicts_do_not_depend_on_what_is_broadcast(spark, sizes):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = pages.unionByName(pages.limit(5)).unionByName(pages.limit(2).withColumn("page_id", F.lit(None)))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(urls.judge_urls(pages, max_words=sizes[0], max_tokens=sizes[1])) == key(urls.judge_urls(pages))


def test_licenses(spark, odd, none):
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(none).count() == 0
    long = max((x[1] for x in licenses.TEMPLATES if x[0] == "MIT"), key=len)
    changed = long.replace("limitation", "bounds").replace("sell copies of", "sell some copies of the")
    text = f"Ünï x. {changed} y {LONG[:3000]} released UNDER the mit license"
    got = licenses.scan_licenses(docs(spark, (1, text, "s"), (None, "Released under the MIT License. " * 3, "s"))).collect()
    first, second = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.start_char)
    assert first.license == "MIT" and first.coverage > 0.9 and text[first.start_char : first.end_char].startswith("Permission is hereby")
    assert text[second.start_char : second.end_char] == "released UNDER the mit license"
    assert sum(r.doc_id is None for r in got) == 3


def test_winnowing_keeps_one_of_every_window():
    grams = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    kept = licenses.winnow(grams, 4)
    assert all(any(i <= k < i + 4 for k in kept) for i in range(47))


def every_diagonal(text, index):
    """Spans by alignment of every template on every diagonal."""
    own, found = decontam.words(text), set()
    for t, template in enumerate(index.words):
        for d in range(-len(template) - index.bands[t], len(own) + index.bands[t] + 1):
            m, a, b = licenses.align(template, own, d, index.bands[t])
            if m >= licenses.COVERAGE * len(template) and index.needed[t] <= set(own[a:b]):
                found.add((index.names[t], m, a, b, m / len(template)))
    left, taken = sorted(found, key=lambda x: (-x[1], -x[4], *x[2:4], x[0])), []
    while left:
        name, m, a, b, _ = left.pop(0)
        taken.append((name, a, b, m))
        left = [x for x in left if x[3] <= a or b <= x[2]]
    return sorted(taken)


def test_licenses_tell_versions_and_clauses_apart():
    index = licenses.Index(licenses.TEMPLATES)
    names = lambda text: [x["license"] for x in licenses.scan_text(text, index)]
    for name, text, _ in licenses.TEMPLATES:
        assert names(f"see {text} and so on") == [name]
    grant = next(x[1] for x in licenses.TEMPLATES if x[0] == "GPL-2.0")
    assert names(grant.replace("program", "file")) == ["GPL-2.0"]
    assert names(grant.replace("either version 2", "either version 7")) == []
    notice = next(x[1] for x in licenses.TEMPLATES if x[0] == "CC-BY-4.0")
    assert names(notice.replace("4.0", "3.0")) == []
    both = " ".join(x[1] for x in licenses.TEMPLATES if x[0] in ("CC-BY-SA-4.0", "GPL-3.0", "ISC"))
    assert names(both) == ["CC-BY-SA-4.0", "GPL-3.0", "GPL-3.0", "ISC"]


def test_licenses_recall_with_edits():
    """Of notices with one and two words changed, put in or left out, all that still cover enough are found."""
    index, rng = licenses.Index(licenses.TEMPLATES), np.random.default_rng(6)
    for t, (name, text, needed) in enumerate(licenses.TEMPLATES):
        own = [w.decode() for w in decontam.words(text)]
        free = [i for i, w in enumerate(own) if w not in needed]
        tried = right = 0
        for edits in [1] * 20 + [2] * 20:
            new, lost = own.copy(), 0
            for i in sorted(rng.choice(free, edits, replace=False).tolist(), reverse=True):
                kind = rng.integers(3)
                new[i : i + (kind > 0)] = [f"odd{i}"] if kind < 2 else []
                lost += kind > 0
            if len(own) - lost >= licenses.COVERAGE * len(own):
                tried += 1
                right += [x["license"] for x in licenses.scan_text(f"so {' '.join(new)} etc", index)] == [name]
        assert not tried or right >= 0.95 * tried, (name, right, tried)


def test_licenses_from_a_table(spark):
    table = spark.createDataFrame([("X-1", "you may use version 1 of this text for anything", ["1"]), ("X-2", "you may use version 2 of this text for anything", ["2"]), ("none", None, None)], "license string, text string, needed array<string>")
    got = licenses.scan_licenses(docs(spark, (1, "You may use version 2 of this text, for anything!", "s")).withColumn("license", F.lit(1)), table).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in got] == [(1, "X-2", 1.0)]
    with pytest.raises(ValueError):
        licenses.load_templates(table.union(table.select("license", F.repeat(F.lit("long "), 2_000_000), "needed").where("license = 'X-1'")))


def test_licenses_with_changed_words():
    index = licenses.Index(licenses.TEMPLATES)
    for text in ("Released under MIT License.", "Released under an MIT License.", "Released under an MIT fine License."):
        assert [(x["license"], x["matched_words"]) for x in licenses.scan_text(text, index)] == [("MIT", 4)]
    short = licenses.Index([t for t in licenses.TEMPLATES if len(decontam.words(t[1])) < 16])
    for t, own in enumerate(short.words):
        own = [w.decode() for w in own]
        for i in range(len(own)):
            for changed in (own[:i] + own[i + 1 :], own[:i] + ["odd"] + own[i + 1 :], own[:i] + ["odd"] + own[i:], own[: i + 1] + own[i:]):
                text = " ".join(["the", "license", *changed, "is", *own[:i]])
                got = [(x["license"], x["start_word"], x["end_word"], x["matched_words"]) for x in licenses.scan_text(text, short)]
                assert sorted(got) == every_diagonal(text, short)
                whole = short.needed[t] <= set(decontam.words(" ".join(changed)))
                assert len(own) * 0.8 > len(own) - 1 or not whole or short.names[t] in {x[0] for x in got}
    for template in [own for own in index.words if len(own) > 30]:
        long = licenses.Index([("x", b" ".join(template).decode())])
        # Every fifth word is another: no run has five words of the template.
        text = "y " + " ".join("odd" if i % 5 == 4 else w.decode() for i, w in enumerate(template))
        got = [(x["license"], x["start_word"], x["end_word"], x["matched_words"]) for x in licenses.scan_text(text, long)]
        assert got == every_diagonal(text, long) and len(got) == 1


def test_op8_query_equals_brute_force(spark, tmp_path):
    """Short documents with notices whole, changed and mixed, by alignment of every template on every diagonal."""
    from cellspark.llm import queries

    rng = np.random.default_rng(8)
    index, texts = licenses.Index(licenses.TEMPLATES), []
    for name in ("MIT", "CC-BY-NC-SA-4.0", "GPL-3.0", "Apache-2.0", "MPL-2.0"):
        own = min((x[1] for x in licenses.TEMPLATES if x[0] == name), key=len).split()
        own[int(rng.integers(len(own)))] = "odd"
        texts.append(" ".join(["some", "words", *own, "and", *own[:3]]))
    texts.append("")
    docs(spark, *((i, x, "s") for i, x in enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in queries.op8_license_scan(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.start_word, r.end_word, r.matched_words))
    assert {k: sorted(v) for k, v in got.items()} == {i: x for i, t in enumerate(texts) if (x := every_diagonal(t, index))}


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    """Nulls, repeated rows, near copies and extra columns through all stages; and no rows at all."""
    import corpus_pipeline

    clean = " ".join(f"w{i}" for i in range(60))
    good = docs(spark, (10, clean, None), (10, clean, None), (11, f"{clean} more", "c"), (None, clean.replace("w", "v"), "d"))
    extra = [c for c in odd.columns if c not in good.columns]
    at = odd.unionByName(good.withColumns({c: F.lit(1) for c in extra}))
    left = {"quality_rules": 4, "line_dedup": 4, "near_duplicates": 2, "decontamination": 2, "encoding": 2}
    for rows, few in ((at, False), (none, True), (at.drop("n_chars"), False)):
        docs_ = rows
        for name, stage in corpus_pipeline.STAGES:
            docs_ = corpus_pipeline.materialise(stage(spark, docs_, "/root/testdata/sf0.001"), name)
            assert docs_.count() == (0 if few else left[name])
            assert name == "encoding" or docs_.columns == rows.columns
