"""Alignment of tokenizers, repeated passages and divergence of sources, against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tandemlake.llm import alignment, decontam, dedup, divergence, html, repeats, secrets
from tandemlake.llm.pages import Pages, write_pages
from tandemlake.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EXTRA = "doc_id bigint, text string, lang string, source string, part int, _all string, term string, n string, seq string, `a.b` string"


def docs_of(spark, rows):
    """doc_id, text, lang, source with extra columns of names that the operators use themselves."""
    return spark.createDataFrame([(i, t, g, s, 1, None, "t", "n", "s", "d") for i, t, g, s in rows], EXTRA)


LONG = " ".join(f"w{i % 977}é" for i in range(30_000))
ODD = [(1, None, "en", "a"), (2, "", None, None), (3, "Same Text again", "en", "b"), (3, "Same Text again", "en", "b"), (None, "same text", "de", "a"), (None, None, None, "a"), (5, LONG, "en", "a"), (6, LONG + "  end ", "en", "a"),
       (7, " \n ", "en", "b"), (8, "naïve ÉTÉ 中文 \x1c x▁y", "fr", "b"), (9, "a <|endoftext|> b </s> <0x0A>", "fr", "b"), (10, "tab\there  two  spaces\n\nlines \n x", "fr", "c"), (11, "x" * 5000 + " " + "ab" * 4000, "en", "c"), (12, "it's 12,345 o'clock—“now” 🙂 é", "es", "a"), (13, "▁", "es", "a"), (14, "\x00 nul", "es", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


class Plainly:
    """The alignment by its definition: byte ranges, shared ends, overlaps."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.back = {chr(x): x for x in letters} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in letters)}

    def of(self, text):
        if not text:
            return None
        want = b" " + text.encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw_a = [bytes(self.back[c] for c in self.a.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := self.b.id_to_piece(i)) else p.replace("▁", " ").encode() for i in b]
        if b"".join(raw_a) != want or b"".join(raw_b) != want:
            return None
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        shared, groups, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        links = []
        for e in shared:
            x, y = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links += [(a[m], b[n]) for m in range(i, x) for n in range(j, y) if max(ends_a[m] - len(raw_a[m]), ends_b[n] - len(raw_b[n])) < min(ends_a[m], ends_b[n])]
            i, j = x, y
        return len(a), len(b), groups, links

    def all(self, rows):
        found = [(i, self.of(t)) for i, t, *_ in rows]
        count = Counter(p for _, f in found if f for p in set(f[3]))
        best = defaultdict(int)
        for (x, _), n in count.items():
            best[x] = max(best[x], n)
        for i, f in found:
            if f is None:
                yield i, 0, 0, 0, 0, 0, 0, ""
            else:
                a, b, groups, links = f
                yield i, a, b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()


@pytest.fixture(scope="module")
def plainly():
    return Plainly()


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_alignment_of_documents(spark, plainly, documents):
    same([tuple(r) for r in entry.queries()["op11_token_alignment"](spark, SF).collect()], plainly.all(documents))


@pytest.mark.parametrize("pages", [1, 64])
def test_alignment_of_odd_rows(spark, plainly, odd, pages, monkeypatch):
    monkeypatch.setattr("tandemlake.llm.pages.PAGES", pages)
    got = alignment.alignment(odd, A, B, with_groups=True)
    same([tuple(r)[:-1] for r in got.collect()], plainly.all(ODD))
    for r in got.where("n_a > 0").collect():
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.n_links == r.n_a + r.n_b - r.n_groups


def test_alignment_of_nothing(spark):
    assert alignment.alignment(docs_of(spark, []), A, B).collect() == []


def test_pages(spark):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 200_000))
    table = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "key bigint, n bigint").repartition(5)
    found = Pages(write_pages(table, ["key", "n"], ["key"]), 2, most=2)
    some = np.sort(np.random.default_rng(2).choice(len(keys), 500, replace=False))
    assert len(found.first) > 3 and (found.of(keys[some])[1] == some).all()
    for x, y in ((0, 199_999), (5, 5), (60_000, 140_000)):
        assert (found.between(int(keys[x]), int(keys[y]))[1] == np.arange(x, y + 1)).all()
    assert found.between(-5, -1).shape == (2, 0)


def test_pages_of_one_key(spark):
    table = spark.range(150_000).selectExpr("id div 100000 as key", "id as at")
    found = Pages(write_pages(table, ["key", "at"], ["key", "at"]), 2)
    assert (found.between(0, 0)[1] == np.arange(100_000)).all() and (found.between(1, 7)[1] == np.arange(100_000, 150_000)).all()


@pytest.fixture(scope="module")
def pair():
    return alignment.Aligner(A, B)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab zé'1,\n\t ▁🙂ßA—") | st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=5))
def test_rows_of_random_texts(pair, plainly, texts):
    for text, got in zip(texts, pair.rows(pa.array(texts)), strict=True):
        want = plainly.of(text)
        assert (got is None) == (want is None)
        if want:
            links = Counter(x * pair.width + y for x, y in want[3])
            assert got[:4] == (want[0], want[1], len(want[2]), ";".join(want[2]).encode()) and dict(zip(got[4].tolist(), got[5].tolist(), strict=True)) == links


def test_steps_of_the_transducer():
    machine = alignment.Transducer([b"ab", b"c", b"abc", b"x"], [b"a", b"bc", b"abc", b"b"])
    assert machine.run([0, 1], [0, 1]) == ([([0, 1], [0, 1])], [(0, 0), (0, 1), (1, 1)])
    assert machine.run([0, 1, 2], [0, 3, 0]) is None and machine.run([3], [0]) is None and machine.run([0], [0]) is None
    assert machine.run([2, 0, 1], [2, 0, 1]) == ([([2], [2]), ([0, 1], [0, 1])], [(2, 2), (0, 0), (0, 1), (1, 1)])
    assert machine.run([], []) == ([], []) and machine.run([], [0]) is None


def divergence_by_hand(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
        held[lang].update(set(terms))
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]

        def shares(of):
            total = sum(counts[lang, of][t] for t in kept)
            return {t: 1 + 10**9 * (counts[lang, of][t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = shares(source), shares(None)
        pairs = sorted((-sum(abs(p[t] - x[t]) for t in kept), s.encode(), s) for g, s in groups if g == lang and s != source for x in [shares(s)])
        terms = sorted((q[t] - p[t], t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t])[:top]
        for part, found in (("pair", pairs), ("term", terms)):
            yield from ((lang, source, part, item, -value, r) for r, (value, _, item) in enumerate(found, 1))


@pytest.mark.parametrize("least,top", [(30, 50), (1, 3), (10**6, 50)])
def test_divergence(spark, odd, documents, least, top):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    same([tuple(r) for r in divergence.divergence(table, least, top).collect()], divergence_by_hand(documents, least, top))
    same([tuple(r) for r in divergence.divergence(odd, least, top).collect()], divergence_by_hand(ODD, least, top))


def test_divergence_of_nothing(spark):
    assert divergence.divergence(docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("long", [divergence.LONG, 6, -1])
def test_terms_at_the_ends_of_texts(spark, monkeypatch, long):
    monkeypatch.setattr(divergence, "LONG", long)
    texts = ["", None, " ", "one", " one", "one ", "\x00One\x7f", "12 one, ONE; two\n", "É@[`{é", "中文🙂 ÉTÉ été", "-_-", "one" + "." * 70_000 + "one"]
    rows = [(i, t, g, s) for i, t in enumerate(texts) for g, s in (("en", None), (None, "b"))]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, held = Counter(), Counter()
    for _, text, lang, source in rows:
        terms = re.findall(divergence.TERM, (text or "").translate(low))
        n.update((lang or "", source or "", t) for t in terms)
        held.update((lang or "", source or "", t) for t in set(terms))
    same([tuple(r) for r in divergence.term_counts(docs_of(spark, rows)).collect()], [(*k, v, held[k]) for k, v in n.items()])


def test_counting_terms_costs_less_than_extracting_them(spark):
    text = "Lorem ipsum dolor sit amet, consectetur adipiscing elit: été, niño. " * 500
    table = spark.createDataFrame([(i, text, "en", "a") for i in range(64)], "doc_id bigint, text string, lang string, source string").repartition(4).cache()
    table.count()

    def seconds(df):
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    extracted = table.select(F.size(F.regexp_extract_all("text", F.lit(divergence.TERM), F.lit(0))))
    took = [(seconds(divergence.term_counts(table)), seconds(extracted)) for _ in range(4)]
    assert min(x for x, _ in took) < min(x for _, x in took)


def test_shares_of_huge_counts(spark):
    n, total, v = 9 * 10**18, 9_100_000_000_000_000_000, 10**6
    got = spark.createDataFrame([(n, total, v)], "n bigint, total bigint, v bigint").select(divergence.share("n", "total", "v")).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


def kept_by_hand(rows, length):
    """doc_id, bytes, removed, runs and hash of rows in order, by a set of all strings."""
    seen, out = set(), []
    for i, raw in rows:
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            if raw[at : at + length] in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(raw[at : at + length])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def in_order(rows):
    return [(i, (t or "").encode()) for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]


def test_repeats_of_documents(spark, documents):
    same([tuple(r) for r in entry.queries()["op12_repeated_passages"](spark, SF).collect()], kept_by_hand(in_order(documents), 100))


PASSAGE = " ".join(f"of {i * i}" for i in range(40))


def edited(n, seed=3):
    """Texts around one passage, whole, cut or changed, and copies of others."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(1, 9)))
    out = []
    for i in range(n):
        p = PASSAGE[r.randrange(60) : len(PASSAGE) - r.randrange(60)] if r.random() < 0.5 else PASSAGE
        if r.random() < 0.3:
            at = r.randrange(len(p))
            p = p[:at] + "#" + p[at + 1 :]
        out.append((r.randrange(-50, 50) * n + i, " ".join([*(word() for _ in range(r.randrange(30))), p, *(word() for _ in range(r.randrange(30)))])))
    copies = [(100 * n + i, r.choice(out)[1]) for i in range(n // 4)]
    return [(i, t, "en", "a") for i, t in (*out, *copies)]


@pytest.mark.parametrize("crowd,chunk,length", [(repeats.CROWD, repeats.CHUNK, 100), (3, 50, 100), (0, 1, 100), (2, 200, 9)])
def test_repeats_of_one_passage(spark, monkeypatch, crowd, chunk, length):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "BLOCK", chunk)
    rows = edited(80) + [(7, "ab" * 400, "x", "y"), (7000001, "xyz" * 90 + "ab" * 300, "x", "y"), (7000002, "a" * 99, "x", "y"), (7000003, "a" * 101, "x", "y")]
    got = repeats.without_repeats(docs_of(spark, rows).repartition(7), length, with_kept=True, crowd=crowd).collect()
    same([tuple(r)[:5] for r in got], kept_by_hand(in_order(rows), length))
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and r.n_spans == len(r.spans) and r.n_removed == sum(s.end - s.start for s in r.spans) and r.n_bytes == len(r.kept) + r.n_removed


def test_repeats_of_odd_rows(spark, odd):
    want = kept_by_hand(in_order(ODD), 100)
    same([tuple(r) for r in repeats.without_repeats(odd).collect()], want)


def test_repeats_of_equal_ids(spark):
    """Rows of one doc_id, or of none, are documents in some order; all but one of each text go."""
    text = PASSAGE * 2
    got = repeats.without_repeats(docs_of(spark, [(1, text, "a", "b")] * 3 + [(None, text[5:], "a", "b"), (0, "x", "a", "b")]).repartition(2)).collect()
    whole = kept_by_hand([(1, text.encode())], 100)[0][2]
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == sorted([(-1, len(text) - 5), (-1, 0), (1, whole), (1, len(text)), (1, len(text))])
    assert sorted(r.n_removed for r in got if r.doc_id == 1) == [whole, len(text), len(text)]


def test_repeats_of_nothing(spark):
    assert repeats.without_repeats(docs_of(spark, [])).collect() == []
    assert [tuple(r)[:4] for r in repeats.without_repeats(docs_of(spark, [(1, None, None, None)])).collect()] == [(1, 0, 0, 0)]


@pytest.mark.parametrize("piece", [repeats.PIECE, 37])
def test_windows_cover_each_string_once(monkeypatch, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    r = random.Random(5)
    texts = ["".join(r.choices("ab", k=k)).encode() for k in (0, 5, 20, 300, 19, 0, 21, 64, 0)]
    limits = np.cumsum([0, *map(len, texts)])
    start, strings, offset, h = repeats.windows(np.frombuffer(b"".join(texts), np.uint8), limits, 20)
    assert sorted(i for s, n in zip(start, strings, strict=True) for i in range(s, s + n)) == [i for x, z in zip(limits, limits[1:], strict=False) for i in range(x, z - 19)]
    by_string = defaultdict(set)
    data = b"".join(texts)
    for s, n, o, x in zip(start.tolist(), strings.tolist(), offset.tolist(), h.tolist(), strict=True):
        for i in range(n):
            by_string[data[s + i : s + i + 20]].add((o - i, x))
    assert all(len(v) == 1 for v in by_string.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"abb", b"\0"]), min_size=10, max_size=120), st.integers(1, 20), st.integers(1, 5), st.booleans())
def test_suffixes_are_sorted(parts, length, groups, lying):
    data = np.frombuffer(b"".join(parts), np.uint8)
    if len(data) < length:
        return
    at = np.random.default_rng(len(data)).permutation(len(data) - length + 1)
    group = np.sort(at % groups)
    raw = data.tobytes()
    want = sorted(range(len(at)), key=lambda i: (group[i], raw[at[i] : at[i] + length], i))
    assert repeats.suffix_order(data, at, group, length).tolist() == want
    seen, again = set(), []
    for i in range(len(at)):
        again.append((group[i], raw[at[i] : at[i] + length]) in seen)
        seen.add((group[i], raw[at[i] : at[i] + length]))
    with pytest.MonkeyPatch.context() as m:
        if lying:  # a hash that takes everything for equal
            m.setattr(repeats.Prefixes, "of", lambda self, x, y: np.zeros(len(x), np.uint64))
        assert repeats.repeats(data, at, group, length).tolist() == again


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- x --!>", "<!-- a --><!---->", "<!-- > -- ->  -->"])
def test_comments_end_where_html_ends_them(comment):
    assert [b.text for b in html.blocks(f"<p>one</p>{comment}<p>two</p>")] == ["one", "two"]


def test_references_are_of_one_run_of_text():
    assert [b.text for b in html.blocks("<p>a &am<b>p;</b> &amp;lt; &l<!-- -->t; &eacute;&#x4e2d;</p>")] == ["a &amp; &lt; &lt; é中"]


@pytest.mark.parametrize("tag,text", [("<p title='a>b'>x</p>", "x"), ('<p title = "a>b\'">x</p>', "x"), ("<p it's>x</p>", "x"), ('<p a="b"c=\'d>\'>x</p>', "x"), ('<p a="b>x</p>', "x"), ("<p a=>x</p>", "x")])
def test_quotes_hold_tags_together(tag, text):
    assert [b.text for b in html.blocks(tag)] == [text]


LARGE = {
    "divs": "<div>" * 60_000 + "x", "inline": "<b>" * 60_000 + "</i>" * 60_000 + "<p>y" + "<hr>" * 60_000, "quotes": "<a x=\"'>" * 60_000, "open quotes": "<a x='>\" " * 60_000,
    "lists": "<blockquote>" * 30_000 + "<li>z" * 30_000, "drawings": "<svg>" + "<g>" * 60_000 + "</q>" * 60_000, "comments": "<!--" * 100_000, "equals": "<a =" * 60_000, "own tags": "".join(f"<x{i}>t" for i in range(50_000)), "blocks": "<div>t" * 60_000,
}


@pytest.mark.parametrize("name", sorted(LARGE))
def test_large_pages_take_a_time_in_proportion(name):
    began = time.process_time()
    html.blocks(LARGE[name])
    assert time.process_time() - began < 5


def test_paths_name_every_element_of_the_training_pages():
    tags = {t.lower() for page in html.pages(200) for t in re.findall(r"<([a-zA-Z][^\s/>]*)", re.sub(r"(?s)<(script|style).*?</\1>", "", page))}
    assert tags - html.RAW - html.VOID - {"html", "body", "div", "span"} <= html.ELEMENTS


def test_long_tokens_are_not_kept():
    encoder = Encoder(A)
    texts = pa.array([f"{i}" + "ab" * 20_000 for i in range(30)])
    encoder.encode(texts)
    assert sum(map(len, encoder.pieces)) < 10_000
    memo = decontam.Memo(lambda token: 1)
    assert memo["x" * 50_000] == 1 and memo["y"] == 1 and list(memo) == ["y"]


def test_only_bare_scans_are_stored(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for bare in (docs, docs.where("doc_id > 3").select("doc_id", "text"), docs.alias("d")):
        assert corpus_pipeline.stored(bare)
    for other in (docs.withColumn("e", F.explode(F.array(F.lit(1), F.lit(2)))).drop("e"), docs.union(docs), docs.sample(0.5), docs.limit(5), docs.join(docs.select("doc_id"), "doc_id"), spark.range(3)):
        assert not corpus_pipeline.stored(other)


def test_stages_of_exploded_rows(spark, tmp_path):
    """Each row twice at one place: one of each group of equal texts stays."""
    from pyspark.sql import functions as F

    spark.createDataFrame([(2, "same", "en", "a", 4), (1, "same", "en", "a", 4), (3, "other words here", "en", "a", 16)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "d"))
    twice = spark.read.parquet(str(tmp_path / "d")).withColumn("e", F.explode(F.array(F.lit(1), F.lit(2)))).drop("e")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, twice, SF).collect()) == [(2, "same"), (3, "other words here")]
    assert len({r.text for r in corpus_pipeline.unlike(spark, twice, SF).collect()}) == corpus_pipeline.unlike(spark, twice, SF).count() == 2


def test_texts_that_do_not_survive_stay_behind(spark):
    """Only rows that share length and prefix reach the hashing worker with their text."""
    rows_ = [(i, f"{i:04d}" + "x" * (1000 + i), "en", "a") for i in range(50)] + [(100 + i, "same text" * 100, "en", "a") for i in range(3)]
    got = dedup.hashes(docs_of(spark, rows_)).collect()
    assert {r.doc_id for r in got if r.survived} == {100, 101, 102} and all((r.sha is not None) == r.survived for r in got)
    plan = dedup.hashes(docs_of(spark, rows_))
    assert {bytes(r.sha) for r in plan.where("survived").collect()} == {hashlib.sha256(b"same text" * 100).digest()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["eyJ", "a", ".", ".eyJ", "-", " ", "é", "eyJa.eyJb.c"]), max_size=25))
def test_web_tokens_are_the_patterns(parts):
    rule = next(r for r in secrets.RULES if r.pattern.startswith("eyJ"))
    text = "".join(parts)
    assert rule.spans(text) == [m.span() for m in re.finditer(rule.pattern, text, re.ASCII)]


def test_long_runs_of_a_tokens_head():
    rule = next(r for r in secrets.RULES if r.pattern.startswith("eyJ"))
    began = time.process_time()
    assert rule.spans("eyJ" * 500_000) == [] and rule.spans("eyJ." * 300_000) == [] and len(rule.spans("eyJa.eyJb.c " * 50_000)) == 50_000
    assert time.process_time() - began < 5
