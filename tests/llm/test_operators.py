"""Each operator against a brute-force version, and its defined results on odd tables."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tandemlake.llm import binary, chat, components, decontam, dedup, html, html_pages, packing, quality, queries, secrets, simhash, warc
from tandemlake.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, part string, bit int, _key string, _id string, seq string, `a.b` string"


def docs_of(spark, rows):
    """A documents table with null and clashing extra columns, and one with a dot."""
    return spark.createDataFrame([(i, t, "p", None, "k", None, "s", "d") for i, t in rows], DOCS)


LONG = " ".join(f"w{i % 977}" for i in range(40_000))
ODD = [(1, None), (2, ""), (3, "Same Text"), (3, "Same Text"), (4, "same text"), (None, "same text"), (None, None), (5, LONG), (6, LONG + " end"), (7, " \n "), (8, "naïve ÉTÉ 中文 \x1c x"), (-9, "Same Text!"), (10, "a <|endoftext|> b")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def tables():
    return {t: duckdb.sql(f"SELECT * FROM '{SF}/{t}.parquet'").fetchall() for t in ("documents", "benchmark", "conversations", "pages", "labels")}


@pytest.fixture(scope="module")
def encoder():
    return Encoder(BPE)


@pytest.fixture(scope="module")
def plain():
    """The library's own tokenizer, as it loads the file."""
    return Tokenizer.from_file(BPE)


# --- tokens ----------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>"]), st.text("ab  \n\t'sreL1٣²é\x1c.-<|中", max_size=12)), max_size=4).map("".join), max_size=6))
def test_ids_equal_the_library(encoder, plain, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()), end=2)
    want = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == want


def test_null_and_special_texts(encoder):
    ids, at = encoder.encode(pa.array([None, "<|endoftext|>", "a  b   c"]))
    assert at[1] == 0 and ids[at[1] : at[2]].tolist() == [50256]
    assert encoder.encode(pa.array(["a <|endoftext|> b"]))[0].tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_are_encoded_whole(name):
    e = Encoder(public_tokenizers.path(name))
    ids, at = e.encode(pa.array(["Hello, World", ""]))
    want = Tokenizer.from_file(public_tokenizers.path(name)).encode("Hello, World", add_special_tokens=False).ids
    assert not e.by_piece and ids[at[0] : at[1]].tolist() == want


def whole_ids(plain, text, end):
    return plain.encode(text or "", add_special_tokens=False).ids + [end]


# --- 5: packing -------------------------------------------------------------------------------------------------


def pieces_hold(plain, rows, got, length=1024):
    by_doc, filled = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq, parts in filled.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at == length or seq == max(filled)
    assert sorted(filled) == list(range(len(filled)))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(whole_ids(plain, t, 0))
    for i, want in texts.items():
        if len(want) > 1:
            assert sum(r.length for r in by_doc[i]) == sum(map(len, want))
            continue
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[0])
            assert r.ids_crc32 == zlib.crc32(np.array(want[0][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[0])


def test_packing(spark, plain, odd, tables):
    pieces_hold(plain, ODD, packing.pack(odd, BPE).collect())
    rows = [(r[0], r[1]) for r in tables["documents"]]
    pieces_hold(plain, rows, queries.op5_packing(spark, SF).collect())


def test_packed_sequences(spark, plain):
    rows = [(i, "word " * (40 * i)) for i in range(9)]
    got = packing.sequences(packing.pack(docs_of(spark, rows).coalesce(1), BPE, length=64), length=64).orderBy("sequence_id").collect()
    ids = [x for r in got for x in r.ids[: r.n_ids]]
    assert ids == [x for _, t in rows for x in whole_ids(plain, t, 0)]
    assert all(len(r.ids) == 64 or r.n_ids & r.n_ids - 1 == 0 for r in got) and all(r.n_ids == 64 for r in got[:-1])
    assert [b.doc_id for r in got for b in r.boundaries if b.start == 0] == list(range(9))


def test_packing_nothing(empty):
    assert packing.pack(empty, BPE).collect() == [] and packing.sequences(packing.pack(empty, BPE)).collect() == []


def test_sequences_of_wide_ids(spark):
    ids = [7, 70_000, 3]
    pieces = spark.createDataFrame([(1, 0, 3, 0, 0, bytearray(np.array(ids, "<u4").tobytes()))], "doc_id bigint, start bigint, length bigint, sequence_id bigint, offset bigint, ids binary")
    assert packing.sequences(pieces, length=4).first().ids == [*ids, 0]


# --- 9: token files ---------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_bits_round_trip(bits, values):
    ids = np.array([v & (1 << bits) - 1 for v in values], np.uint32)
    assert binary.unpack_bits(binary.pack_bits(ids, bits), bits, len(ids)).tolist() == ids.tolist()


def test_random_access(tmp_path):
    r = np.random.default_rng(0)
    docs = [r.integers(0, 50257, n) for n in (0, 1, 70_000, 63, 64, 65, 200_000, 3)]
    with open(tmp_path / "t", "wb") as f:
        w = binary.Writer(f, binary.bits_for(50257))
        for i in (0, 3):
            part = docs[i : i + 3] if i == 0 else docs[3:]
            w.add(pa.array([None if j == 1 else j for j in range(i, i + len(part))], pa.int64()), np.concatenate(part), np.cumsum([0, *map(len, part)]))
        w.close()
    with open(tmp_path / "t", "rb") as f:
        got = binary.Reader(f, (tmp_path / "t").stat().st_size)
        assert got.bits == 16 and got.nulls.tolist() == [i == 1 for i in range(8)]
        for i in (6, 2, 7, 0, 5, 1):
            assert got.document(i).tolist() == docs[i].tolist()
        assert got.ids(69_990, 70_010).tolist() == np.concatenate(docs)[69_990:70_010].tolist()


def test_token_files(spark, plain, odd, tables):
    files = binary.write_tokens(odd, BPE, end=2)
    got = binary.read_tokens(files).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    want = {}
    for i, t in ODD:
        want.setdefault(i, []).append(whole_ids(plain, t, 2))
    at = 0
    for r in got:
        assert r.start == at and r.ids in want[r.doc_id]
        at += r.n_tokens
    start = 0
    found = {r.doc_id: r for r in queries.op9_token_binary(spark, SF).collect()}
    for i, t, *_ in sorted(tables["documents"]):
        ids = whole_ids(plain, t, 2)
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_one_id(spark, plain):
    rows = [(4, f"text {i % 3}") for i in range(200)] + [(None, "x"), (3, "first"), (5, "<|endoftext|>")]
    got = binary.read_tokens(binary.write_tokens(docs_of(spark, rows).repartition(3), BPE, end=2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 3, *[4] * 200, 5] and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)]).tolist()[:-1]
    assert sorted(r.ids for r in got) == sorted(whole_ids(plain, t, 2) for _, t in rows)
    assert len({tuple(r.ids) for r in got[2:70]}) <= 2  # equal texts stand together


def test_token_files_of_nothing(empty):
    assert binary.read_tokens(binary.write_tokens(empty, BPE, end=2)).collect() == []


# --- 3: exact dedup ---------------------------------------------------------------------------------------------


def low(t):
    return (t or "").encode().lower()


def test_exact_dedup(odd):
    got = dedup.exact_dedup(odd, all_hashes=True).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(hashlib.sha256(low(t)).digest(), []).append(i)
    for sha, ids in groups.items():
        mine = [r for r in got if bytes(r.sha) == sha]
        best = max((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and {r.keep_id for r in mine} == {best} and {r.group_size for r in mine} == {len(ids)}
        assert [r.doc_id for r in mine if r.kept] == [best]


def test_full_hash_only_where_needed(odd):
    got = dedup.exact_dedup(odd).collect()
    assert {r.doc_id for r in got if r.sha is None} >= {5, 6, 8, -9} and all(r.sha is not None for r in got if r.group_size > 1)
    one_bit = dedup.exact_dedup(odd, bits=64).collect()  # keys that share a bit change nothing
    view = lambda rows: sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in rows)
    assert view(got) == view(one_bit)


def test_without_copies(odd, empty):
    got = dedup.without_copies(odd)
    assert got.columns == odd.columns
    assert sorted((low(r.text) for r in got.collect())) == sorted({low(t) for _, t in ODD})
    assert dedup.without_copies(empty).collect() == [] and dedup.exact_dedup(empty).collect() == []


@pytest.mark.parametrize("stored", [False, True])
def test_one_row_of_each_group_stays(spark, tmp_path, stored):
    rows = [(None, "a"), (None, "A"), (4, "b"), (4, "b"), (4, "B"), (2, "b"), (9, None), (None, ""), (7, "alone"), (7, "Also alone")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, part int")
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d")) if stored else docs.repartition(4)
    got = dedup.without_copies(docs, stored)
    assert got.schema == docs.schema
    kept = [(r.doc_id, low(r.text)) for r in got.collect()]
    best = {}
    for i, t in rows:
        best[low(t)] = max(best.get(low(t), -1), -1 if i is None else i)
    assert sorted((-1 if i is None else i, t) for i, t in kept) == sorted((i, t) for t, i in best.items())


def test_lengths_come_before_prefixes(spark):
    alone = docs_of(spark, [(i, "x" * i) for i in range(30)])
    assert not dedup.survivors(alone.select("doc_id", "text"), 64, 1 << 10).any()  # all lengths differ
    pair = docs_of(spark, [(1, "ab"), (2, "cd"), (3, "AB"), (4, "efg")])
    assert sum(int(w).bit_count() for w in dedup.survivors(pair.select("doc_id", "text"), 64, 1 << 10).view(np.uint64)) == 1


# --- 8: SimHash -------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    parts = [{i} for i in range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2 and parts[i] is not parts[j]:
                parts[j] |= parts[i]
                for k in parts[i]:
                    parts[k] = parts[j]
    return [min((rows[k][0] for k in p if rows[k][0] is not None), default=None) for p in parts]


def test_near_duplicates(spark, odd, tables):
    for rows, got in ((ODD, simhash.near_duplicates(odd)), ([r[:2] for r in tables["documents"]], queries.op8_simhash_near_dedup(spark, SF))):
        fps = [(i, slow_fingerprint(t)) for i, t in rows]
        want = sorted(repr((i, f"{f:016x}", c)) for (i, f), c in zip(fps, slow_components(fps)))
        assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_masks_cover_every_pair():
    tables = simhash.masks()
    for i in range(64):
        for j in range(i):
            assert any(not m & (1 << i | 1 << j) for m in tables)


@pytest.mark.parametrize("local", [1 << 16, 2])
def test_links_in_crowded_buckets(spark, local):
    r = random.Random(2)
    base = r.getrandbits(64)
    near = {base ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for _ in range(300)} | {r.getrandbits(64) for _ in range(50)}
    fps = spark.createDataFrame([(simhash.signed(x),) for x in near], "fp bigint")
    roots = {x.node: x.root for x in components.components(simhash.links(fps, local)).collect()}
    ids = sorted(simhash.signed(x) for x in near)
    want = slow_components([(i, i & (1 << 64) - 1) for i in ids])
    assert [roots.get(i, i) for i in ids] == want


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert set(got.values()) == {0, 900} and len(got) == 303
    assert components.components(edges.limit(0)).collect() == []


def test_representatives(odd, empty):
    got = simhash.representatives(odd)
    assert got.columns == odd.columns and sorted(r.doc_id for r in got.collect() if r.doc_id is not None)[0] == -9
    assert simhash.representatives(empty).collect() == [] and simhash.near_duplicates(empty).collect() == []


def test_no_text_of_a_repeated_id_is_lost(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    got = simhash.representatives(docs_of(spark, [(3, a), (7, a), (7, b)]).repartition(2)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, a), (7, b)]


def test_representatives_by_row(spark):
    twin = " ".join(f"t{i}" for i in range(400))
    texts = [(3, twin), (5, twin.upper()), (5, "a text of its own that is unlike any other"), (None, twin), (None, "no id but one text of a kind"), (None, "nor has this one any"), (None, "NOR has this one any"), (7, "said twice with one id"), (7, "Said twice with one id"), (8, "the very same row"), (8, "the very same row"), (9, None), (9, "")]
    got = [(r.doc_id, r.text) for r in simhash.representatives(docs_of(spark, texts).repartition(3)).collect()]
    fps = [slow_fingerprint(t) for _, t in texts]
    part = slow_components([(k, f) for k, f in enumerate(fps)])
    order = lambda k: (texts[k][0] is None, texts[k][0] or 0, hashlib.sha256((texts[k][1] or "").encode()).hexdigest())
    want = [texts[min((k for k in range(len(texts)) if part[k] == c), key=order)] for c in set(part)]
    view = lambda rows: sorted((repr(i), t or "") for i, t in rows)
    assert view(got) == view(want) and len(got) == 7


# --- 6: secrets -------------------------------------------------------------------------------------------------


def slow_spans(text):
    base = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    return [f"{k}:{a}:{z}" for a, i, k, z in sorted((m.start(), i, k, m.end()) for i, (k, p, g, n) in enumerate(base) for m in p.finditer(text or "") if len(m[g]) >= n)]


def slow_more(text):
    """The further kinds: their patterns tried at every place of the text, from left to right."""
    kinds = [("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0), ("code_host", "gh[pousr]_[A-Za-z0-9]+", 40), ("chat", "xox[abprs]-[A-Za-z0-9-]+", 15), ("web_api", "AIza[0-9A-Za-z_-]+", 39), ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0)]
    out = []
    for kind, pattern, least in kinds:
        at = 0
        while at < len(text):
            m = re.compile(pattern, re.A).match(text, at)
            if m and len(m[0]) >= least:
                out.append((kind, m.start(), m.end()))
            at = m.end() if m else at + 1
    return sorted(out)


def test_further_kinds_by_hand():
    r = random.Random(6)
    heads = ["gho_", "xoxb-", "AIza", "eyJ", ".eyJ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", ".", " ", "é"]
    texts = ["".join(r.choice(heads) + r.choice("aB0-_") * r.randrange(45) for _ in range(8)) for _ in range(300)]
    plan = secrets.planned(secrets.MORE)
    got = [sorted((secrets.MORE[k].kind, a, z) for a, k, z in spans) for spans in secrets.find_in(pa.array(texts, pa.string()), plan)]
    assert got == [slow_more(t) for t in texts] and sum(map(len, got)) > 100


def test_the_parsed_regex_is_what_is_expected():
    """The queries stand on Python's own parse of a pattern; a change of its shape has to show."""
    assert [op for op, _ in secrets.parser.parse("a[bc](?:de|f)+x?.^")] == [secrets.sre.LITERAL, secrets.sre.IN, secrets.sre.MAX_REPEAT, secrets.sre.MAX_REPEAT, secrets.sre.ANY, secrets.sre.AT]


PLANTED = ["PassWord = 'abcdefgh12'", "api_key:short", 'APIKEY="xyzxyzxyz', "AKIA" + "A1" * 8, "AKIAB", "é" * 5 + "0123456789abcdef" * 2 + "g", "token: token: aaaaaaaaa", "ſecret=aaaaaaaaa", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "pas sword=aaaaaaaaaa", "f" * 31]


def test_secrets(spark, odd, tables):
    rows = [(i, f"x{p} y") for i, p in enumerate(PLANTED)] + [(99, " ".join(PLANTED)), (98, "a" * 100_000 + " secret=" + "b" * 9)]
    got = {r.doc_id: r for r in secrets.find_secrets(docs_of(spark, rows)).collect()}
    base = {r.kind for r in secrets.BASE}
    for i, t in rows:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in got[i].spans if s.kind in base] == slow_spans(t)
    assert [s.kind for s in got[8].spans] == ["private_key"] and "code_host" in [s.kind for s in got[9].spans]
    for i, t in rows:
        assert sorted((s.kind, s.start, s.end) for s in got[i].spans if s.kind not in base) == slow_more(t)
    for r in queries.op6_secret_scan(spark, SF).collect():
        text = next(d[1] for d in tables["documents"] if d[0] == r.doc_id)
        want = slow_spans(text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and r.n_hex == sum(w.startswith("hex") for w in want)
    assert len(secrets.find_secrets(odd).collect()) == len(ODD)


def test_trigram_queries():
    assert secrets.trigrams_of("AKIA[A-Z0-9]+") == ("grams", "aki", "kia")
    assert secrets.trigrams_of("[0-9a-f]+") == secrets.ALL == secrets.trigrams_of("ab|abcd")
    assert secrets.trigrams_of("abc(?:de)?fgh") == ("or", ("grams", "abc", "bcd", "cde", "def", "efg", "fgh"), ("grams", "abc", "bcf", "cfg", "fgh"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcde:=\"' x", max_size=25), max_size=6), st.sampled_from(["ab[cd]e", "(abc|bcd)+e", "a?bcd", "abc.*bcd", "(?:ab)+c"]))
def test_index_misses_no_match(texts, pattern):
    rule = secrets.Rule("r", pattern)
    got = secrets.find_in(pa.array(texts, pa.string()), secrets.planned((rule,)))
    assert [[(a, z) for a, _, z in spans] for spans in got] == [[m.span() for m in re.finditer(pattern, t) if m.end() > m.start()] for t in texts]


# --- 1: decontamination -----------------------------------------------------------------------------------------

QUESTION = "A train leaves the station at 60 mph and travels for 3 hours before it meets Alice at the old bridge. How far did the train travel before it met Alice at the bridge after 3 hours?"
OTHER = "A train leaves the station at 85 mph and travels for 7 hours before it meets Robert at the old bridge. How far did the train travel before it met Robert at the bridge after 7 hours?"
BROKEN = "A train leaves the station at 85 mph and travels for 7 hours before it meets Robert at the old bridge. How far did the train travel before it met Carol at the bridge after 9 hours?"


def benchmark(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id bigint, text string, doc_id string")


def test_templates_and_slots(spark):
    noise = "some plain words that go on before and after it all in this place"
    rows = [(1, f"{noise} {QUESTION} {noise}"), (2, f"{noise}. {OTHER} {noise}"), (3, BROKEN), (4, noise), (5, None), (6, QUESTION.upper()), (7, "3 4 5 6 7 8 9"), (None, QUESTION), (8, " ".join(QUESTION.split()[:14]))]
    got = decontam.contamination(docs_of(spark, rows), benchmark(spark, QUESTION, "1 2 3 4 5 6 7", None, "", "word")).collect()
    assert sorted((r.doc_id for r in got if r.item_id == 0), key=repr) == [1, 2, 6, None]
    assert not [r for r in got if r.item_id in (1, 2, 3)]  # all slots, other values; no words
    for r in got:
        if r.doc_id == 1 and r.item_id == 0:
            assert " ".join(rows[0][1].split()[r.first : r.last]).startswith("train leaves") or r.first <= len(noise.split()) + 1
    assert [r.doc_id for r in got if r.item_id == 4] == []


def test_blocks_of_the_benchmark(spark):
    b = benchmark(spark, QUESTION, "quite another passage of plain words here", OTHER)
    d = docs_of(spark, [(1, QUESTION), (2, "quite another passage of plain words here")])
    view = lambda x: sorted((r.doc_id, r.item_id) for r in x.collect())
    assert view(decontam.contamination(d, b)) == view(decontam.contamination(d, b, most=10)) == [(1, 0), (1, 2), (2, 1)]


def test_other_items_do_not_matter(spark):
    lena = "Yesterday Lena paid 5 dollars for a box of apples. Then Lena gave Rose half of it, as Will had asked."
    omar = "Yesterday Omar paid 7 dollars for a box of apples. Then Omar gave Vera half of it, as Paul had asked."
    rest = ["Omar sells many good things at the fair.", "a rose that paul will see, so vera said, is red", "Then again, yesterday is gone."]
    d = docs_of(spark, [(1, omar), (2, lena.upper()), (3, lena.lower()), (4, f"so {lena}"), (5, omar.replace("Then Omar", "Then Carl").replace("Vera", "Omar").replace("Paul", "Omar"))])
    view = lambda b, most: sorted(tuple(r) for r in decontam.contamination(d, b, most=most).collect() if r.item_id == 0)
    alone = view(benchmark(spark, lena), 1 << 20)
    assert [r[0] for r in alone if r[2] == 1] == [1, 2, 3, 4]
    for most in (10, 200, 1 << 20):
        assert view(benchmark(spark, lena, *rest), most) == alone


def test_benchmark_passages_are_found(spark, tables):
    found = {(r.doc_id, r.item_id) for r in queries.op1_benchmark_decontamination(spark, SF).collect()}
    held = {(i, k) for i, t, *_ in tables["documents"] for k, b in tables["benchmark"] if b in (t or "")}
    assert found == held and held


def test_uncontaminated(spark, odd, empty):
    b = benchmark(spark, QUESTION)
    d = docs_of(spark, [(1, QUESTION), (2, "clean"), (3, None)])
    got = decontam.uncontaminated(d, b)
    assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == [2, 3]
    assert decontam.contamination(empty, b).collect() == [] and decontam.contamination(odd, b.limit(0)).collect() == []
    assert len(decontam.uncontaminated(odd, b.limit(0)).collect()) == len(ODD)


@pytest.mark.parametrize("stored", [False, True])
def test_uncontaminated_by_blocks(spark, tmp_path, stored):
    b = benchmark(spark, QUESTION, "quite another passage of plain words here", None, "and a third one, of other words still")
    rows = [(1, QUESTION), (2, "clean"), (3, None), (2, f"so {OTHER}"), (None, "it is quite another passage of plain words here"), (None, "clean"), (4, ""), (2, "clean"), (5, "clean " * 50_000)]
    d = docs_of(spark, rows).withColumn("_row", F.lit(1)).repartition(3)
    if stored:
        d.write.parquet(str(tmp_path / "docs"))
        d = spark.read.parquet(str(tmp_path / "docs"))
    view = lambda x: sorted(map(repr, x.collect()))
    want = view(decontam.uncontaminated(d, b, stored=stored))
    got = decontam.uncontaminated(d, b, most=10, stored=stored)
    assert got.columns == d.columns and view(got) == want and len(want) == 6
    assert view(decontam.uncontaminated(d.limit(0), b, most=10)) == []


def slow_template(text):
    """Readings of each template word: a set of the words that it can match, and its slot value."""
    out = []
    for token in text.split():
        core = token.strip(".,?!")
        if not core:
            continue
        if core.isdigit():
            out.append(({"#"}, core))
        else:
            out.append(({core.lower(), "N"} if core[0].isupper() else {core.lower()}, core.lower()))
    return out


def slow_match(item, text, window=5, least=0.8):
    """Whether some stretch of the text holds the item's windows: every pair of windows is compared."""
    a, b = slow_template(item), slow_template(text)
    lower = {v for r, v in a if len(r) == 1}
    a = [({"N"} | r if len(r) == 2 and v not in lower and k else r - {"N"}, v) for k, (r, v) in enumerate(a)]  # an item's own names are those capitalised in mid-sentence alone
    size = min(window, len(a))
    views = [tuple("N" if "N" in r else next(iter(r)) for r, _ in a[i : i + size]) for i in range(len(a) - size + 1)]
    first = {v: i for i, v in reversed(list(enumerate(views)))}
    hits = [(p, v) for p in range(len(b) - size + 1) for v, i in first.items() if all(x[0] & y[0] for x, y in zip(a[i : i + size], b[p : p + size]))]
    need, span = math.ceil(least * len(first)), int(1.5 * len(a)) + 1
    return any(len({v for p, v in hits if q <= p < q + span}) >= need for q in {p for p, _ in hits})


def test_templates_against_a_scan():
    """Items whose slots can't disagree (their values never repeat) against a comparison of all windows."""
    r = random.Random(4)
    seen = [0, 0]
    for _ in range(300):
        words = [r.choice("abcdefgh") + "x" for _ in range(r.randrange(3, 14))]
        for k in r.sample(range(len(words)), r.randrange(0, len(words) // 3 + 1)):
            words[k] = r.choice([str(r.randrange(10, 99)), f"Q{r.choice('aeiou')}w"])
        item = " ".join(dict.fromkeys(words))
        text = item.split()
        for k in range(len(text)):
            if text[k].isdigit() and r.random() < 0.7:
                text[k] = str(100 + k)
            elif text[k][0] == "Q" and r.random() < 0.7:
                text[k] = f"R{'abcdefghijklmnop'[k]}v"
            elif r.random() < 0.05:
                text[k] = "zz"
        noise = [r.choice("abcdefghz") + "x" for _ in range(30)]
        at = r.randrange(30)
        text = " ".join(noise[:at] + text + noise[at:])
        block = decontam.Block([(1, item)], 5, 0.8)
        got = bool(block.matches(*decontam.Words(block.vocabulary, block.names).template(text)))
        slots = sum(w.isdigit() or w[0].isupper() for w in item.split())
        if slots * 2 > len(item.split()) or item[0].isupper():
            continue  # little but slots, or a name where a sentence begins: other rules
        assert got == slow_match(item, text), (item, text)
        seen[got] += 1
    assert min(seen) > 20


def longest_run(a, b):
    """The most consecutive words of a that b holds, every pair of places compared."""
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        last = [0, *(last[j] + 1 if x == y else 0 for j, y in enumerate(b))]
        best = max(best, *last)
    return best


def test_parts_of_long_items_against_a_scan():
    """A part of RUN words is enough, whatever its share and wherever it stands; numbers in it may be others, one for one."""
    r = random.Random(6)
    seen = [0, 0]
    vocabulary = [a + b + c for a in "bdfgklmn" for b in "aiou" for c in "pqstx"]
    for _ in range(150):
        item = [r.choice(vocabulary) for _ in range(r.randrange(55, 400))]
        if r.random() < 0.2:
            item = (item[:23] * 20)[: len(item)]  # windows that repeat
        a = r.randrange(len(item) - 20)
        part = item[a : a + r.choice([20, 45, 49, 50, 51, 60, 90])]
        if r.random() < 0.3:
            part[r.randrange(len(part))] = "zz"
        noise = [r.choice(vocabulary) for _ in range(r.randrange(80))]
        at = r.randrange(len(noise) + 1)
        text = noise[:at] + part + noise[at:]
        block = decontam.Block([(1, " ".join(item))], 5, 0.8)
        got = block.matches(*decontam.Words(block.vocabulary, block.names).template(" ".join(text)))
        run = longest_run(item, text)
        assert bool(got) == (run >= decontam.RUN or slow_match(" ".join(item), " ".join(text))), (item, text)
        for _, share, first, last in got:
            assert share >= 0.8 or last - first == run and longest_run(item, text[first:last]) == run
        seen[bool(got)] += 1
    assert min(seen) > 20


def test_numbers_of_a_part(spark):
    words = [f"{a}{b}" for a in ("red", "low", "far", "dim", "wet", "raw") for b in "abcdefghijklmnopqrstuvwxy"]
    item = " ".join(w if k % 15 else f"{w} {10 + k}" for k, w in enumerate(words))
    part = " ".join(item.split()[20:90])
    other = " ".join(str(int(w) + 500) if w.isdigit() else w for w in part.split())
    merged = " ".join("7" if w.isdigit() else w for w in part.split())
    docs = docs_of(spark, [(1, part), (2, f"so {other} it is"), (3, merged), (4, " ".join(part.split()[:49])), (5, part.replace(" ", "  "))])
    got = decontam.contamination(docs, benchmark(spark, item)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 5]  # merged numbers aren't one for one
    assert sorted(r.doc_id for r in decontam.uncontaminated(docs, benchmark(spark, item)).collect()) == [3, 4]


def test_slots_map_one_to_one(spark):
    item = "Now take 12 of the red ones and 34 of the blue ones, then add 12 of the red and 34 of the blue to all that you have had so far here."
    same, other, merged, split = (item.replace("12", a).replace("34", b) for a, b in (("12", "34"), ("56", "78"), ("90", "90"), ("55", "66")))
    split = split.replace("55", "44", 1).replace("66", "33", 1)
    got = decontam.contamination(docs_of(spark, [(1, same), (2, other), (3, merged), (4, split)]), benchmark(spark, item)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2]


def test_shuffled_and_extended_benchmarks(spark):
    r = random.Random(9)
    words = [w.title() if r.random() < 0.2 else w for w in (a + b for a in "bdfgk" for b in ("ax", "ox", "ix"))]
    items = [" ".join([*(r.choice(words) for _ in range(r.randrange(6, 20))), str(r.randrange(50))]) for _ in range(30)]
    docs = docs_of(spark, [(k, " ".join(r.choice(words) for _ in range(20)) + " " + r.choice(items) + " so") for k in range(60)])
    view = lambda order, most: sorted((x.doc_id, items[order[x.item_id]], x.share, x.first, x.last) for x in decontam.contamination(docs, benchmark(spark, *(items[k] for k in order)), most=most).collect() if order[x.item_id] < 20)
    every, mixed = list(range(30)), r.sample(range(30), 30)
    want = view(every, 1 << 20)
    assert len(want) > 30 and view(mixed, 300) == want and view(list(range(20)), 1 << 20) == want


# --- 7: quality -------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    got = queries.op7_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").df()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.93


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    x, limits, y = rng.normal(size=(7, quality.FEATURES)), np.array([0, 3, 4, 7]), np.array([1.0, 0, 1])
    w = {"W": rng.normal(0, 0.1, (quality.FEATURES, 4)), "b": np.zeros(4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "d": np.zeros(1)}
    loss = lambda: -np.sum(y * np.log(p := quality.forward(w, x, limits)["p"]) + (1 - y) * np.log(1 - p))
    for k, g in quality.gradients(w, x, limits, y, np.ones(3)).items():
        at = tuple(0 for _ in w[k].shape)
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4
        w[k][at] += 1e-5


def test_scores_do_not_depend_on_neighbours():
    texts = ["one text", "", "Another!! TEXT", "x" * 9000, None]
    data = lambda t: quality.utf8(pa.array(t, pa.string()))
    together = quality.features(*(lambda d, at: (d, *quality.passages(at)[:2]))(*data(texts)))
    apart = np.concatenate([quality.features(*(lambda d, at: (d, *quality.passages(at)[:2]))(*data([t]))) for t in texts])
    assert np.array_equal(together, apart)


def bags_of(spark, texts, labels, monkeypatch, **more):
    """What fit would train on: {doc_id: (quality, features)}."""
    seen = []
    monkeypatch.setattr(quality, "train", seen.append)
    quality.fit(docs_of(spark, texts).repartition(5), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), **more)
    monkeypatch.undo()
    return {r.doc_id: (r.quality, np.frombuffer(r.x, np.float32).reshape(-1, quality.FEATURES)) for r in seen[0].collect()}


def learnt(n):
    return [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 5][:n]


@pytest.mark.parametrize("size", [131_072, 131_073, 1 << 20])
def test_every_passage_of_a_long_text_trains(spark, monkeypatch, size):
    text = "".join(chr(97 + i * i % 23) for i in range(size))
    ids = learnt(2)
    rows, labels = [(ids[0], text), (ids[1], "short")], [(ids[0], 1, 0), (ids[1], 0, 0)]
    bags = bags_of(spark, rows, labels, monkeypatch)
    assert len(bags[ids[0]][1]) == -(-size // quality.PASSAGE) and len(bags[ids[1]][1]) == 1
    data, at = quality.utf8(pa.array([text]))
    assert np.array_equal(bags[ids[0]][1], quality.features(data, *quality.passages(at)[:2]))
    monkeypatch.setattr(quality, "STEPS", 3)
    docs = docs_of(spark, rows)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert set(got) == set(ids) and {r.doc_id for r in quality.kept(docs, model, 0.0).collect()} == set(ids)
    assert abs(got[ids[0]] - slow_score(model, bags[ids[0]][1])) < 1e-4


def slow_score(model, bag):
    """A bag's score, a passage and a number at a time."""
    w = {k: a.astype(float).tolist() for k, a in model.w.items()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    dot = lambda v, m, j: sum(a * row[j] for a, row in zip(v, m))
    hidden, weight = [], []
    for passage in bag.tolist():
        x = [(a - m) / s for a, m, s in zip(passage, model.mean.tolist(), model.scale.tolist())]
        h = [math.tanh(dot(x, w["W"], j) + w["b"][j]) for j in range(quality.HIDDEN)]
        hidden.append(h)
        weight.append(math.exp(sum(w["w"][j] * math.tanh(dot(h, w["V"], j)) * sig(dot(h, w["U"], j)) for j in range(quality.GATE))))
    z = [sum(a * h[j] for a, h in zip(weight, hidden)) / sum(weight) for j in range(quality.HIDDEN)]
    return sig(sum(a * b for a, b in zip(z, w["c"])) + w["d"][0])


def test_score_of_random_bags_by_hand():
    rng = np.random.default_rng(3)
    w = {k: rng.normal(0, 0.4, a.shape).astype(np.float32) for k, a in quality.start().items()}
    model = quality.Model(w, rng.normal(size=quality.FEATURES).astype(np.float32), rng.uniform(0.5, 2, quality.FEATURES).astype(np.float32))
    bags = [rng.normal(size=(n, quality.FEATURES)).astype(np.float32) for n in (1, 4, 2, 7)]
    got = model.score(np.concatenate(bags), np.cumsum([0, *map(len, bags)]))
    assert np.allclose(got, [slow_score(model, b) for b in bags], atol=1e-4)


def test_gradients_are_summed_over_tasks(spark):
    rng = np.random.default_rng(4)
    bags = [rng.normal(size=(n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 2, 5, 1, 2, 2)]
    y = np.array([0, 1, 1, 0, 1, 0, 1], np.float32)
    table = spark.createDataFrame([(int(k), bytearray(b.tobytes())) for k, b in zip(y, bags)], "quality int, x binary").repartition(3)
    w = {k: a.astype(np.float32) for k, a in quality.start().items()}
    got = quality.summed(table, lambda x, limits, y: quality.gradients(w, x, limits, y, np.ones(len(y), np.float32)))
    want = quality.gradients(w, np.concatenate(bags), np.cumsum([0, *map(len, bags)]), y, np.ones(7, np.float32))
    assert all(np.allclose(got[k], want[k], atol=1e-4) for k in w)
    assert quality.summed(table.limit(0), quality.moments) == {} and quality.moments(np.concatenate(bags), None, y)["labels"] == [3, 4]


def test_one_training_row_of_each_id(spark, monkeypatch):
    ids = learnt(4)
    labels = [(i, k % 2, 0) for k, i in enumerate(ids)]
    texts = [(ids[0], f"text {j}") for j in range(50)] + [(i, f"of {i}") for i in ids[1:]]
    one, other = (bags_of(spark, rows, labels, monkeypatch, per_class=2) for rows in (texts, texts[::-1]))
    assert {i: q for i, (q, _) in one.items()} == {i: k % 2 for k, i in enumerate(ids)}
    assert all(len(x) == 1 and np.array_equal(x, other[i][1]) for i, (_, x) in one.items())


def test_quality_without_labels(spark, odd, empty):
    none = spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 7, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(odd, none)
    assert {r.score for r in quality.score(odd, model).collect()} == {0.5} and len(quality.kept(odd, model).collect()) == len(ODD)
    assert quality.score(empty, model).collect() == [] and quality.kept(empty, model).columns == empty.columns


# --- 2: pages ---------------------------------------------------------------------------------------------------


def test_blocks_of_a_page():
    page = "<!DOCTYPE html><title>no</title><style>x{}</style><p>a <b>b</b>c&amp;d<!-- x --> e<br>f<p>g<ul><li>h<li>i</ul><script>if (a<b) '</p>'</script>j < k<table><tr><td>l<td>m</table>&copy; n"
    assert [b.text for b in html.blocks(page)] == ["a bc&d e", "f", "g", "h", "i", "j < k", "l", "m", "© n"]


@pytest.mark.parametrize("tag", "noscript svg math object canvas audio video".split())
def test_no_container_loses_the_article(tag):
    assert html.trained().text(f"<html><body><article><{tag}>{SHORT}</article></body></html>") == html.trained().text(f"<html><body><article>{SHORT}</article></body></html>")
    assert [b.text for b in html.blocks(f"<p>one <{tag}>two</{tag}> three</p><p>four")] == ["one two three", "four"]


def test_formulas_and_drawings_stay():
    math = "<p>So <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> holds.</p>"
    svg = "<p>See <svg viewBox='0 0 1 1'><title>no</title><g><path d='M0 0'/><text>a label</text></g></svg> here.</p>"
    assert [b.text for b in html.blocks(math + svg + "<template><p>t</p></template><p>z")] == ["So x=2 holds.", "See a label here.", "t", "z"]
    assert [b.text for b in html.blocks("<svg><g><text>a</text><p>b</p><ul><li>c</ul>")] == ["a", "b", "c"]
    assert [b.text for b in html.blocks("<title>a<p>b")] == [b.text for b in html.blocks("<script>a")] == []


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "</", "&", "<p>&am", "<script>", "<a href='", "plain"])
def test_broken_pages(page):
    assert isinstance(html.trained().text(page), str)


def test_fresh_pages():
    right = wrong = 0
    for p in html_pages.pages(150, seed=77):
        found, labels = html.labelled(p)
        got = html.trained().labels(found)
        wrong += sum(a != b for a, b in zip(got, labels))
        right += sum(a == b for a, b in zip(got, labels))
    assert wrong / (right + wrong) < 0.02


def test_viterbi_finds_the_best_labelling():
    from itertools import product

    f = html.trained()
    for p in html_pages.pages(40, seed=5):
        found, _ = html.labelled(p)
        if 1 < len(found) <= 9:
            e = [f._emission(b) for b in found]
            total = lambda y: f.start[y[0]] + sum(x for x, k in zip(e, y) if k) + sum(f.move[a][b] for a, b in zip(y, y[1:]))
            best = max(product((0, 1), repeat=len(found)), key=total)
            assert abs(total(best) - total(f.labels(found))) < 1e-9


ARTICLE = "<article><h1>Title here</h1><p>First &eacute; part.</p><p>Second<br>part</p></article>"
AROUND = [
    "<nav><a href=/>Home</a></nav>{}<footer>&copy; Us</footer>",
    "<header><h1>Site</h1><form><input><button>Go</button></form></header>{}<aside>Other reads</aside>",
    '<div class="cookie-notice">We use cookies. <button>Fine</button></div><main>{}</main><section id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b> So true, thank you for it.</div></section>',
    '<div class="sidebar"><p>Popular things to read now.</p></div>{}<div class="ad">Buy this now.</div><div class="newsletter"><form><p>Get our letter.</p><input></form></div>',
]


SHORT = "<h1>The title</h1><p>First part of it, long enough for a paragraph.</p><p>Ti.</p><ul><li>one</li><li>two</li></ul>"
PLACES = [
    '<a class="skip-link" href="#c">Skip to content</a><div id="content">{}</div>',
    "{}",
    '<div role="banner">Site</div><div role="main">{}</div><div role="complementary"><p>Other things to see, friends.</p></div><div role="contentinfo">A firm</div>',
    '<article>{}<div class="ad">Buy it.</div></article><section class="reader-comments"><article class="comment"><p>I like this a lot, and say so at length.</p></article></section>',
    '<div class="content-sidebar-wrap"><main class="content"><article class="post entry">{}</article></main><aside class="sidebar"><h3>Find</h3></aside></div>',
    '<div class="post">{}</div><div class="post-comments"><h3>Comments</h3><p>Ann: I agree with every word of this, all of it.</p></div>',
    '<table><tr><td class="menu"><a href=x>A</a><br><a href=y>B</a></td><td class="content">{}</td></tr></table><div id="footer">bye</div>',
    "<article>{}<section class='comments'><p>Bob: well said.</p></section><footer>Filed under x</footer></article>",
]


@pytest.mark.parametrize("place", PLACES)
def test_articles_in_many_places(place):
    assert html.trained().text(f"<html><body>{place.format(SHORT)}</body></html>") == "The title First part of it, long enough for a paragraph. Ti. one two"


@pytest.mark.parametrize("around", AROUND)
def test_article_of_a_page(around):
    assert html.trained().text(f"<html><body>{around.format(ARTICLE)}</body></html>") == "Title here First é part. Second part"


def test_extract(spark, tables):
    rows = [(1, "u", ARTICLE), (1, None, None), (None, "v", ""), (2, "w", "<p>" + "x " * 50_000)]
    got = html.extract(spark.createDataFrame([(*r, 3) for r in rows], "page_id bigint, url string, html string, text int")).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got)[:2] == [0, 0] and all(r.n_chars == len(r.text) for r in got)
    for r in queries.op2_html_extraction(spark, SF).collect():
        page = next(p[2] for p in tables["pages"] if p[0] == r.page_id)
        inner = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
        import html as entities

        assert r.text == " ".join(entities.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())


# --- 10: chats --------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=6), st.lists(st.sampled_from([*chat.CONTROLS, chat.ESCAPE, "<", "|", "[", "a", "\n", "é", "n"]), max_size=6).map("".join)), min_size=1, max_size=5))
def test_assembly_round_trip(turns):
    turns = [(r.encode("utf-8", "ignore").decode(), t) for r, t in turns]
    out, limits, a, z = chat.assemble(pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()))
    assert chat.parse(out.tobytes().decode()) == turns
    for i, (_, t) in enumerate(turns):
        inside = out[a[i] : z[i]].tobytes().decode()
        assert chat.unescape(inside) == t and not any(c in inside for c in chat.CONTROLS)


def test_a_long_conversation_is_in_small_pieces(spark):
    """A third of all rows in one conversation, and a turn longer than a piece."""
    rows = [(1 if k % 3 == 0 else 2 + k // 30, k, "assistant" if k % 2 else "user", f"{k} says </s> " * 20) for k in range(3000)]
    rows[21] = (1, 21, "assistant", "x" * 200_000)
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    pieces = sorted((r.chunk, r.n_turns, r.formatted) for r in chat.format_chats(turns).where("conv_id = 1").collect())
    assert sum(len(f) > 2 * chat.PIECE for _, _, f in pieces) == 1 and len(pieces) > 5
    assert [x for _, _, f in pieces for x in chat.parse(f)] == [(role, text) for c, _, role, text in rows if c == 1]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "assistant", queries.CONTROL_CASE), (2, 5, "assistant", ""), (1, 1, "assistant", "a"), *[(7, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(5000)]]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, chunk string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\na\nassistant\nb\n") and got[1].loss_sha256 == sha("ab") and got[1].loss_chars == 2
    assert got[2].loss_sha256 == sha(queries.CONTROL_CASE) and got[2].n_turns == 2 and got[None].loss_chars == 0
    assert got[7].n_turns == 5000 and got[7].turns_sha256 == sha("".join(f"{'assistant' if i % 2 else 'user'}\nt{i}\n" for i in range(5000)))
    assert chat.digests(chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).collect() == []


# --- 4: WARC ----------------------------------------------------------------------------------------------------

PAGES = [(i, f"http://x/{i}", f"<p>page {i} é</p>" * (i % 7)) for i in range(700)] + [(None, None, None), (5, "u", "again"), (5, "u", "again"), (900, "bad\r\nHeader: x", "z" * 100_000)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    one, other = (f"file://{tmp_path_factory.mktemp('w')}/{n}" for n in ("one", "other"))
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id bigint, url string, html string, shard int")
    return warc.write_warc(pages.repartition(5), one), one, other  # several files


def test_warc_round_trip(archive):
    index, one, _ = archive
    got = warc.read_warc(index, one).collect()
    want = [(i, (u or "").replace("\r", "").replace("\n", ""), h or "") for i, u, h in PAGES]
    assert sorted(repr((r.page_id, r.url, r.html)) for r in got) == sorted(map(repr, want))


def test_audit_finds_the_damage_alone(archive):
    from pyspark.sql import functions as F

    index, one, other = archive
    warc.copied(index, one, other, (F.col("page_id") % 50 == 3) | F.col("page_id").isNull())
    bad = {(r.shard, r.seq) for r in warc.audit(index, one, other).collect()}
    want = {(r.shard, r.seq) for r in index.collect() if r.page_id is None or r.page_id % 50 == 3}
    assert bad == want and len(bad) == 15
    assert warc.audit(index, one, one).collect() == []
    import os

    folder = other.removeprefix("file://")
    files = sorted(os.listdir(folder))
    with open(f"{folder}/{files[0]}", "ab") as f:
        f.write(b"more")
    os.remove(f"{folder}/{files[-1]}")
    bad2 = {(r.shard, r.seq) for r in warc.audit(index, one, other).collect()}
    gone = {(r.shard, r.seq) for r in index.collect() if warc.name_of(r.shard) == files[-1]}
    assert gone and gone <= bad2 and len({s for s, _ in bad2 - want - gone}) == 1


def test_descent_looks_only_below_what_differs(archive, spark, tmp_path):
    from pyspark.sql import functions as F

    index, one, _ = archive
    low = index.agg(F.min("shard")).first()[0]
    a, inner = warc.tree(index, one)
    assert warc.descend(a, warc.tree(index, one)[0], inner, low)[1] == [1]  # equal roots end it
    where = f"file://{tmp_path}/hurt"
    victims = [tuple(r) for r in index.select("shard", "seq").orderBy("shard", "seq").collect()][:: len(PAGES) // 2][:2]
    warc.copied(index, one, where, F.struct("shard", "seq").isin(*[F.struct(F.lit(x).alias("shard"), F.lit(y).alias("seq")) for x, y in victims]))
    bad, seen = warc.descend(a, warc.tree(index, where)[0], inner, low)
    assert sorted(map(tuple, bad.collect())) == sorted(victims)
    assert len(seen) == len(a) and seen[0] == 1 and all(n <= warc.FAN * len(victims) for n in seen)
    assert sum(seen) < index.count() // 4


def test_nodes_hash_their_children(archive):
    index, one, _ = archive
    levels, inner = warc.tree(index, one)
    nodes = [{(r.shard, r.idx): bytes(r.hash) for r in level.collect()} for level in levels]
    for level in range(1, inner + 1):
        for (shard, idx), h in nodes[level].items():
            kids = sorted((i, x) for (s, i), x in nodes[level - 1].items() if s == shard and i // warc.FAN == idx)
            assert h == warc.parent(kids)
    assert len(nodes[-1]) == 1


def test_extra_files_are_seen(archive, spark, tmp_path):
    from pyspark.sql import functions as F

    index, one, _ = archive
    where = f"file://{tmp_path}/more"
    warc.copied(index, one, where, F.lit(False))
    assert warc.extra_files(index, one, where).collect() == [] and warc.audit(index, one, where).collect() == []
    (tmp_path / "more" / "stray.warc.gz").write_bytes(b"x")
    (tmp_path / "more" / warc.name_of(77)).write_bytes(b"")
    assert sorted(map(tuple, warc.extra_files(index, one, where).collect())) == [(warc.name_of(77), "other"), ("stray.warc.gz", "other")]
    assert {r.replica for r in warc.extra_files(index, where, one).collect()} == {"one"}


def test_warc_of_nothing(spark, tmp_path):
    index = warc.write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), f"file://{tmp_path}/a")
    assert index.collect() == [] and warc.audit(index, f"file://{tmp_path}/a", f"file://{tmp_path}/b").collect() == []
    assert warc.extra_files(index, f"file://{tmp_path}/a", f"file://{tmp_path}/b").collect() == [] and warc.read_warc(index, f"file://{tmp_path}/a").collect() == []


# --- queries with SQL -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == sorted(repr(list(r)) for r in rel.select(*order).fetchall())


def test_all_are_registered():
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()
