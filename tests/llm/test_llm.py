"""The training-data operators against brute force, on small fixtures and on the smallest tables."""

import hashlib
import html as html_module
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import bpe, exact_dedup, html_text, jaccard_groups, line_chunks, packing, ppm, quality, queries, sharding, warc

TOKENS = queries.tokenizer_path()
WORDS = "the of and to in is that it was for on are as with his they at be this from ubiquitous granite ledger harbour violet comet".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "", ",", "."])) for _ in range(n))


def awkward_documents(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(4)
    base = [prose(rng, n) for n in (3, 12, 60, 300)]
    texts = [None, "", " \t\n ", "x", "日本語 テスト", "Straße ĳ don't <|endoftext|> 12", base[0], base[1], base[2], base[3], base[2] + " extra", base[2], base[2].replace(" ", "  "), "a\n\nb\na", "word " * 30, prose(rng, 9000)]
    rows = [(i, t, None if i % 5 == 0 else ["en", "de"][i % 2], "src", None if t is None else len(t), "s", 1, "g", "h", True, 1, "n") for i, t in enumerate(texts)]
    rows.append(rows[8])
    rows += [(None, *rows[7][1:]), (None, base[3] + " without an id", *rows[6][2:]), (None, None, *rows[6][2:])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot_ string, `dotted.name` int, component_id string, h string, kept boolean, length int, sha string")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


# ---- 1 packing


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "tok"):
        ids_of.tok = Tokenizer.from_file(TOKENS)
    return ids_of.tok.encode(text or "", add_special_tokens=False).ids


def check_packing(rows, texts, capacity):
    want = Counter()
    for doc, text in texts:
        ids = ids_of(text) + [0]
        for i in range(0, len(ids), capacity):
            part = np.array(ids[i : i + capacity], "<u4").tobytes()
            want[doc, i // capacity, i, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    total = sum(r.length for r in rows)
    return len(sequences), -(-total // capacity)


def test_packing_is_whole_and_tight(spark, documents, texts):
    rows = packing.pack_documents(documents, TOKENS).collect()
    used, least = check_packing(rows, list(texts.items()), 2048)
    histogram = Counter(r.length for r in rows)
    configurations, report = packing.solve(histogram, 2048)
    assert used == report["sequences"] and least <= report["bound"] <= used <= report["bound"] + 3
    assert report["by_program"] >= 0.9 * report["pieces"]
    placed = {length: {round(first + i) for first, times, c in zip(np.cumsum([0, *(t for _, t in configurations)]), (t for _, t in configurations), (c for c, _ in configurations)) if length in dict(c) for i in range(times)} for length in histogram}
    assert all(r.sequence_id in placed[r.length] for r in rows)  # the query's places are the program's


def test_packing_awkward_rows(spark):
    docs = awkward_documents(spark)
    check_packing(packing.pack_documents(docs, TOKENS, 512).collect(), [(r.doc_id, r.text) for r in docs.collect()], 512)
    assert packing.pack_documents(empty_documents(spark), TOKENS).count() == 0


def test_plan_holds_every_piece():
    rng = random.Random(2)
    histogram = Counter(rng.choice([rng.randrange(1, 300), 256, 17]) for _ in range(20_000) if True)
    histogram = {min(k, 256): 0 for k in histogram} | Counter({min(k, 256): v for k, v in histogram.items()})
    made = packing.plan(histogram, 256)
    held = Counter()
    for config, times in made:
        assert sum(length * k for length, k in config) <= 256
        for length, k in config:
            held[length] += k * times
    assert held == Counter({k: v for k, v in histogram.items() if v})
    assert sum(t for _, t in made) <= 1.01 * -(-sum(k * v for k, v in histogram.items()) // 256) + 1


# ---- 2 sharding


def check_shards(rows, n, shards):
    assert len(rows) == n
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_shards(spark, sf, texts):
    rows = queries.op2_hypergeometric_shards(spark, sf).collect()
    check_shards(rows, len(texts), 16)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_shards_awkward_rows(spark):
    docs = awkward_documents(spark)
    check_shards(sharding.shuffle_to_shards(docs, 5).collect(), docs.count(), 5)
    assert sharding.shuffle_to_shards(empty_documents(spark), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_to_shards(docs.withColumnRenamed("source", "SLOT"), 3)


def test_communication_matrix_is_exact_and_uniform():
    counts, sizes = [30, 0, 50, 20], sharding.shard_sizes(100, 3)
    sums = np.zeros((4, 3))
    for seed in range(300):
        m = np.array(sharding.communication_matrix(counts, sizes, seed))
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes
        sums += m
    np.testing.assert_allclose(sums / 300, np.outer(counts, sizes) / 100, atol=0.5)


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(0)
    draws = [sharding.hypergeometric(rng, 3 * 10**9, 9 * 10**9, 400) for _ in range(1500)]
    assert abs(np.mean(draws) - 100) < 1 and abs(np.std(draws) - 75**0.5) < 0.6


# ---- 3 quality rules


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def slow_distance(p, q):
    p, q = np.array(p) / sum(p), np.array(q) / sum(q)
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    return (max(0.0, kl(p) + kl(q)) / 2) ** 0.5


def test_quality_rules(spark, documents, texts):
    reference = quality.references(documents)
    rows = quality.judge(documents, reference).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = slow_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        if not r.base_failed:
            own = quality.histograms(texts[r.doc_id].encode().split(), texts[r.doc_id].encode())
            pairs = [(slow_distance(own[:7], h[:7]), slow_distance(own[7:], h[7:])) for h in reference.values()]
            char, word = min(pairs, key=sum)
            assert (r.char_distance, r.word_distance) == (pytest.approx(char), pytest.approx(word))
            assert r.kept == ((own[:7].sum() < 60 or char <= 0.31) and (want[0] < 120 or word <= 0.32))
        else:
            assert not r.kept


def test_quality_keeps_good_documents(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality.judge(documents, quality.references(documents)).join(labels, "doc_id")
    good = kept.where("quality = 1 AND NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = kept.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good >= 0.97 and (bad is None or bad <= 0.5)


def test_repeated_words_with_many_distinct_words():
    rng = random.Random(1)
    words = [str(rng.randrange(9000)).encode() for _ in range(20_000)]
    words[15_000:15_040] = words[100:140]
    text = b" ".join(words).decode()
    assert quality.repeated_words(words) == slow_counts(text)[4]


def test_quality_awkward_rows(spark):
    docs = awkward_documents(spark)
    assert quality.judge(docs, quality.references(docs)).count() == docs.count()
    assert quality.judge(docs, {}).where("kept <> (NOT base_failed)").count() == 0
    assert quality.keep_clean(docs, quality.references(docs)).columns == docs.columns
    none = empty_documents(spark)
    assert quality.references(none) == {} and quality.judge(none, {}).count() == 0


# ---- 4 WARC


def pages(spark):
    rows = [(1, "http://a/\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", ""), (4, "u", None), (5, "u", "é" * 5000), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n"), (None, "u", "<p>x</p>"), (7, "u", "single"), (7, "u", "single")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    got = warc.archive_and_read(pages(spark)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    assert len(got) == 9 and len(by[7]) == 2
    first = by[1][0]
    assert first.payload == b"<p>x</p>" and first.record_type == "response" and first.payload_digest == warc.digest(b"<p>x</p>")
    assert (by[2][0].record_type, by[2][0].refers_to, by[2][0].payload, by[2][0].payload_bytes) == ("revisit", 1, None, 8)
    assert (by[4][0].record_type, by[4][0].refers_to, by[4][0].payload_bytes) == ("revisit", 3, 0)
    assert by[5][0].payload.decode() == "é" * 5000
    assert by[6][0].payload == b"WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n"
    assert {r.record_type for r in by[7]} == {"response"} and by[None][0].record_type == "response"
    small = {r.page_id: r.record_type for r in warc.archive_and_read(pages(spark), least_revisit=5).collect()}
    assert small[4] == "response" and small[2] == "revisit"
    assert warc.archive_and_read(pages(spark).limit(0)).count() == 0


def test_splitting_does_not_depend_on_blocks():
    whole = b"".join(warc.record(i, "u", bytes([65 + i]) * (i * 700), None) for i in range(6))
    for size in (1, 7, 1000, 10**6):
        parts = [r for _, r in warc.split_records(whole[i : i + size] for i in range(0, len(whole), size))]
        assert b"".join(parts) == whole and len(parts) == 6
    with pytest.raises(ValueError):
        list(warc.split_records(iter([whole[:-30]])))


# ---- 5 HTML


def test_main_text_of_pages(spark, sf):
    rows = html_text.extract_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", source[r.page_id], re.S)[1]
        blocks = [" ".join(html_module.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<p>Tom &amp; <b>Je</b>rry\n\t ran  <a href='x'>far</a> away from the big house on the hill today<p>Then they slept", "Tom & Jerry ran far away from the big house on the hill today\nThen they slept"),
        ("<body><nav><a>Home</a> <a>News</a></nav><main><h2>Head</h2><p>Some words that are the text.</p><div class='comments'><p>I like it very much indeed</p></div></main><footer>bye</footer>", "Head\nSome words that are the text."),
        ("<article><header><h1>Title here</h1></header><p>Body &lt;one&gt;</p><script>x='<p>no</p>'</script><!-- <p>no</p> --><form><p>Name</p></form></article><aside><p>also read this long long text</p></aside>", "Title here\nBody <one>"),
        ("<p>open <script>never closed <p>gone", "open"),
        ("<p>a < b and c > d are all here in this sentence of text", "a < b and c > d are all here in this sentence of text"),
    ],
)
def test_main_text_cases(page, text):
    assert html_text.main_text(page) == text


def test_tree_fits_its_table_and_awkward_pages(spark):
    assert all(html_text.classify(r[:-1]) == r[-1] for r in html_text.LABELLED)
    rows = html_text.extract_text(pages(spark)).collect()
    assert len(rows) == 9 and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract_text(pages(spark).limit(0)).count() == 0
    assert len(html_text.main_text("<div>" * 3000 + "x" * 100)) == 100


def test_trees_split_on_neighbours():
    def used(node):
        return {html_text.FEATURES[node[0]]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()

    assert {"words_before", "links_before", "words_after", "links_after", "heading"} <= used(html_text.plain_tree())
    assert {"words_before", "words_after"} <= used(html_text.tree())
    assert all(html_text.classify(r[:-1], html_text.plain_tree()) == r[-1] for r in html_text.LABELLED_PLAIN)


def test_neighbours_decide():
    rng = random.Random(15)
    long, other = prose(rng, 60), prose(rng, 70)
    menu = "<ul><li><a href='/a'>One</a><li><a href='/b'>Two</a></ul>"
    parts = ["<div>We use small files to remember you</div>", menu, "<div>Buy nine granite ledgers for the price of two</div>", "<h1>The harbour at night</h1>"]
    page = "".join([*parts, f"<p>{long}</p><p>They slept.</p><p>{other}</p>", "<div>&copy; example, all rights are ours</div>"])
    assert html_text.main_text(page) == f"The harbour at night\n{long}\nThey slept.\n{other}"
    linked = "<a href='/x'>" + prose(rng, 16) + "</a> " + prose(rng, 14)
    text_of = lambda x: re.sub("<[^>]*>", "", x)
    assert html_text.main_text(f"<article><p>{long}</p><p>{linked}</p><p>{other}</p></article>") == f"{long}\n{text_of(linked)}\n{other}"
    assert html_text.main_text(f"<article><p>{long}</p>{menu}<p>{linked}</p>{menu}</article>") == long
    more = prose(rng, 30)
    assert html_text.main_text(f"<article><p>{long}</p></article><p>{other}</p><p>{more}</p><p>{other}</p>") == "\n".join([long, other, more, other])
    assert html_text.main_text(f"<article><p>{long}</p></article>{menu}<p>{more}</p>{menu}") == long


@pytest.mark.parametrize("tag", ["button", "select", "svg", "object", "math", "canvas"])
def test_unclosed_dropped_element_ends_with_the_one_around_it(tag):
    for end in ("</p>", ""):
        assert html_text.main_text(f"<article><p>One is here<{tag} x='1'>gone{end}<p>Two is here</p></article>") == "One is here\nTwo is here"
    assert html_text.main_text(f"<article><div><{tag}>gone<svg><div>gone</div></div>Two</article>") == "Two"
    assert html_text.main_text(f"<article><p>One <{tag}><div>gone</div></{tag}> two</p></article>") == "One\ntwo"


def test_unclosed_head_ends_with_the_first_text_element():
    assert html_text.main_text("<html><head><meta charset='x'><title>no</title><p>Here is the text</p></html>") == "Here is the text"
    assert html_text.main_text("<html><head><style>x</style></head><p>Here is the text</p></html>") == "Here is the text"


PROSE = "The harbour was quiet that night and nobody had seen the ledger since the comet went over the hills. " * 2


@pytest.mark.parametrize("name", ["content no-sidebar", "post has-header-image", "article-body share-enabled", "site-header", "main content notice-free"])
def test_names_do_not_empty_a_page(name):
    assert html_text.main_text(f'<div class="{name}"><p>{PROSE}</p><p>{PROSE}</p><div class="ad">Buy a lamp now</div></div>').count("harbour") == 4


def test_named_furniture_goes():
    for name in ("ad", "sidebar-left", "cookieNotice", "site-header", "comment_list", "widget2"):
        page = f'<div class="{name}"><p>{PROSE}</p></div><div class="post"><p>{PROSE * 3}</p><p>{PROSE}</p></div>'
        assert html_text.main_text(page).count("harbour") == 8, name
    inside = f'<div class="sidebar"><p>{PROSE * 3}</p><div class="ad"><p>Buy a lamp now and be glad of it</p></div><p>{PROSE}</p></div>'
    assert "lamp" not in html_text.main_text(inside) and "harbour" in html_text.main_text(inside)


@pytest.mark.parametrize("bad", ["<div><p>", '<a title="', "<a \"'>", "<a href='x>", "<!-", "</div>", "<div class='ad'>x", "<svg><math>", "<"])
def test_broken_pages_take_time_in_proportion(bad):
    import time

    start = time.perf_counter()
    html_text.main_text(bad * 100_000)
    assert time.perf_counter() - start < 20  # seconds, on a loaded machine; a quadratic walk takes minutes


# ---- 6 Jaccard join


def slow_classes(rows):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


def near_copies(rng, clusters, copies):
    rows = []
    passage = prose(rng, 30)
    for _ in range(clusters):
        words = [f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        if rng.random() < 0.5:
            words[5:5] = passage.split()
        for _ in range(rng.randrange(1, copies)):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("wide, rounds", [(3, 3)])
def test_jaccard_classes(spark, wide, rounds):
    rows = near_copies(random.Random(8), 14, 14)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups.jaccard_classes(df, wide=wide, rounds=rounds).collect()}
    assert got == slow_classes(rows)


def check_classes(spark, rows, **options):
    """Rows of ids (null, repeated) and texts against brute force: each pair of id and text is a document."""
    named = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    slow = slow_classes([(k, text) for k, (_, text) in enumerate(named)])
    place = {row: k for k, row in enumerate(named)}
    want = Counter((doc, slow[place[doc, text]][0], named[slow[place[doc, text]][1]][0]) for doc, text in rows)
    got = jaccard_groups.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_jaccard_awkward_rows(spark):
    docs = awkward_documents(spark)
    check_classes(spark, [(r.doc_id, r.text) for r in docs.collect()])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert jaccard_groups.jaccard_classes(docs).count() == docs.count()
    assert jaccard_groups.jaccard_classes(empty_documents(spark)).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_jaccard_null_and_repeated_ids(spark):
    rng = random.Random(31)
    a, b = prose(rng, 60), prose(rng, 60)
    check_classes(spark, [(1, a), (5, a), (5, b), (7, b + " more"), (None, a + " other"), (None, b), (None, prose(rng, 50)), (5, b)])


def test_jaccard_opens_groups_of_many_sets(spark):
    """Hubs make groups of several sets; sets near some of their members only must still find them, whichever side they stand on."""
    rng = random.Random(77)
    rows = []
    for _ in range(3):
        words = [f"{rng.choice(WORDS)}{rng.randrange(10**4)}" for _ in range(90)]
        for _ in range(30):  # a long chain of near copies, each a little further from the first
            words = list(words)
            words[rng.randrange(90)] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    check_classes(spark, list(enumerate(rows)), wide=5, rounds=2)


def test_a_set_that_many_ask_for_goes_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_groups, "ASKING", 3)
    check_classes(spark, near_copies(random.Random(18), 6, 30), wide=4)


# ---- 7 BPE


def test_bpe_is_the_library(spark, documents, texts):
    rows = bpe.encode_decode(documents, TOKENS).collect()
    digests = {r.doc_id: r for r in bpe.encode_decode(documents, TOKENS, digests_only=True).collect()}
    ids_of("")
    for r in rows:
        ids = ids_of(texts[r.doc_id])
        decoded = ids_of.tok.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == decoded
        assert digests[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[r.doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_awkward_texts():
    rng = random.Random(6)
    alphabet = "ab Zé'sßΣσİ\t\n \x1c1²Ⅷ,.!<|endoftext|>日́"
    cases = ["", " ", "don't we'll 'S", "Él" * 700, "x<|startoftext|>y", "ΑΣ ΣΑΣ.", "éa ́b"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 90))) for _ in range(600)]
    want = [ids_of(t) for t in cases]
    assert [x.tolist() for x in bpe.encoder(TOKENS).texts(cases)] == want
    for mean in (2, 16, 1024):
        assert [x.tolist() for x in bpe.chunk_encoder(TOKENS, mean).texts(cases)] == want


def test_equal_chunks_are_encoded_once():
    """Counted by the chunks themselves: joins are no reuse."""
    rng = random.Random(9)
    shared = prose(rng, 3000)
    texts = [prose(rng, 40) + " " + shared for _ in range(10)]
    made = bpe.ChunkEncoder(TOKENS, 256)
    seen = Counter(raw for t in texts for inner, raw in made.cut(t.encode()) if inner)
    for t in texts:
        made.texts([t])
    assert (made.encoded, made.reused) == (len(seen), sum(seen.values()) - len(seen)) and made.reused > 5 * made.encoded
    assert made.reused_bytes == sum((n - 1) * len(raw) for raw, n in seen.items()) and made.grown == 0


class PhraseBase:
    """Tokens that span white space, which this tokenizer family has not: neighbours of a join can disagree with their chunks."""

    def many(self, stretches):
        out = []
        for raw in stretches:
            words, ids, i = raw.split(), [], 0
            while i < len(words):
                two = i + 1 < len(words) and words[i].endswith(b"w") and words[i + 1].startswith(b"y")
                ids.append(zlib.crc32(b" ".join(words[i : i + 1 + two])))
                i += 1 + two
            out.append(np.array(ids, np.uint32))
        return out


def test_joins_grow_until_both_sides_agree():
    rng = random.Random(12)
    grown = 0
    for mean in (8, 24, 64):
        made = bpe.ChunkEncoder(TOKENS, mean)
        made.base = PhraseBase()
        for _ in range(60):
            text = " ".join(rng.choice(["new", "york", "a", "bow", "yard", "harbour", "yew"]) + rng.choice(["", "", "  "]) for _ in range(rng.randrange(0, 80))).encode()
            # each white space may be where a chunk ends and the next begins, so phrases are torn
            assert made.many([text])[0].tolist() == made.base.many([text])[0].tolist()
        grown += made.grown
    assert grown > 100


def test_bpe_awkward_rows(spark):
    docs = awkward_documents(spark)
    rows = bpe.encode_decode(docs, TOKENS).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((r.doc_id, tuple(ids_of(r.text))) for r in docs.collect())
    assert bpe.encode_decode(empty_documents(spark), TOKENS).count() == 0


# ---- 8 line chunks


def slow_lines(rows, mean):
    first, places = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: r[0]):
        lines = (text or "").encode().split(b"\n")
        for place, (a, b) in enumerate(line_chunks.chunk_spans(lines, mean)):
            if b - a > 1 and sum(bool(x.strip()) for x in lines[a:b]) > 1:
                places[doc, place] = (a, b)
                first.setdefault(b"\n".join(lines[a:b]), (doc, place))
    out = {}
    for doc, text in rows:
        lines = (text or "").encode().split(b"\n") if text is not None else []
        gone = set()
        for (d, place), (a, b) in places.items():
            if d == doc and first[b"\n".join(lines[a:b])] != (doc, place):
                gone |= set(range(a, b))
        out[doc] = b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode(), len(gone)
    return out


def test_line_chunks(spark):
    rng = random.Random(12)
    passages = [[prose(rng, 9) for _ in range(rng.randrange(3, 12))] for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [[prose(rng, 6) for _ in range(rng.randrange(0, 7))] for _ in range(3)]
        for p in parts[1:]:
            p += rng.choice(passages)
        rows.append((i, "\n".join(x for p in parts for x in p)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_chunks.drop_repeated_chunks(df).collect()}
    assert got == slow_lines(rows, 4)
    assert sum(n for _, n in got.values()) > 100
    assert {r.doc_id: r.n_removed for r in line_chunks.drop_repeated_chunks(df.where("doc_id = 0")).collect()}[0] == slow_lines(rows[:1], 4)[0][1]


def test_line_chunks_shift_resistant():
    rng = random.Random(13)
    passage = [prose(rng, 8).encode() for _ in range(40)]
    cuts = lambda lines: {b"\n".join(lines[a:b]) for a, b in line_chunks.chunk_spans(lines, 4)}
    shifted = cuts([b"one more", b"line"] + passage)
    assert len(cuts(passage) - shifted) <= 1


def test_line_chunks_awkward_rows(spark):
    docs = awkward_documents(spark).where("doc_id IS NOT NULL")  # rows without an id are in test_repeated_runs
    got = {r.doc_id: (r.text, r.n_removed) for r in line_chunks.drop_repeated_chunks(docs).collect()}
    assert got == slow_lines([(r.doc_id, r.text) for r in docs.collect()], 4)
    assert line_chunks.drop_repeated_chunks(empty_documents(spark)).count() == 0


def slow_runs(rows):
    """The lines that stay, for each row: of each two neighbouring lines with words only the first place counts."""
    first, out = {}, []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").encode().split(b"\n")
        worded = [i for i, x in enumerate(lines) if x.strip()]
        for a, b in zip(worded, worded[1:]):
            first.setdefault(b"\n".join(lines[a : b + 1]), (doc, text, a))
    for doc, text in rows:
        lines = (text or "").encode().split(b"\n")
        worded = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for a, b in zip(worded, worded[1:]):
            d, t, at = first[b"\n".join(lines[a : b + 1])]
            if (d, t, at) != (doc, text, a):
                gone |= {i for i in range(a, b + 1) if (d, t) != (doc, text) or i > at + b - a}
        out.append((doc, [x.decode() for i, x in enumerate(lines) if i not in gone and x.strip()]))
    return out


def test_short_repeated_runs_go_whole(spark):
    rng = random.Random(14)
    passages = [[prose(rng, 9) + f" p{k} {j}" for j in range(2 + k % 4)] for k in range(12)]
    rows, rims = [], []
    for i in range(40):
        head, tail = ([prose(rng, 5) + f" {side}{i} {j}" for j in range(rng.randrange(1, 4))] for side in "ht")
        rows.append((i, "\n".join([*head, *passages[i % 12], *tail])))
        rims.append([*head, *(passages[i] if i < 12 else []), *tail])
    rows += [(50, rows[3][1]), (51, "same\nsame\nsame"), (52, "p\n\nq\n\nr"), (53, "x\np\n\nq\ny"), (54, "u\nv"), (54, "w\nu\nv\nz"), (54, "w\nu\nv\nz"), (None, "n\nm"), (None, "k\nn\nm"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_chunks.drop_repeated_runs(df).collect()
    kept = [(r.doc_id, [x for x in r.text.split("\n") if x.strip()]) for r in got]
    assert sorted(x for d, x in kept if d is not None and d < 40) == sorted(rims)
    by = {d: x for d, x in kept if d is not None and 50 <= d < 54}
    assert by == {50: [], 51: ["same", "same"], 52: ["p", "q", "r"], 53: ["x", "y"]}
    assert Counter((d, *x) for d, x in kept if d != 54 and d is not None) == Counter((d, *x) for d, x in slow_runs(rows) if d != 54 and d is not None)
    # texts under one id, or without any, are documents of their own: the pair stays in exactly one of them
    for doc, pair, whole in ((54, ("u", "v"), 3), (None, ("n", "m"), 3)):
        own = [x for d, x in kept if d == doc]
        assert len(own) == whole and len({tuple(x) for x in own if set(pair) <= set(x)}) == 1
    # no line loses its last copy
    assert {x for _, t in rows for x in (t or "").split("\n") if x} == {x for _, t in kept for x in t}


# ---- 9 language


def test_language(spark, sf, documents, texts):
    rows = queries.op9_ppm_language(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in documents.collect()}
    assert len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def slow_bits(tree_text, text):
    """Code length of a text by a plain variable-order model, one byte after the other."""
    counts = [defaultdict(Counter) for _ in range(4)]

    def steps(folded):
        raw = b"   " + folded
        for i in range(3, len(raw)):
            if not (raw[i] == 32 and raw[i - 1] == 32):
                yield raw, i

    for raw, i in steps(tree_text):
        for k in range(4):
            counts[k][raw[i - k : i]][raw[i]] += 1
    bits = 0.0
    for raw, i in steps(text):
        for k in (3, 2, 1, 0):
            seen = counts[k].get(raw[i - k : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if raw[i] in seen:
                bits -= np.log2(seen[raw[i]] / whole)
                break
            bits -= np.log2(len(seen) / whole)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    samples = {"a": ppm.fold("the quick brown fox jumps over the lazy dog and the cat " * 3), "b": ppm.fold("der schnelle braune Fuchs springt über den faulen Hund " * 3)}
    model = ppm.Model(samples)
    texts = [ppm.fold(t) for t in ("the dog", "Über den Fuchs!", "zzz qqq 12 xy", "", "日本", "  a  b ")]
    bits, _ = model.bits(texts)
    for i, t in enumerate(texts):
        for k, name in enumerate(model.langs):
            assert bits[i, k] == pytest.approx(slow_bits(samples[name], t), rel=1e-4, abs=1e-3)


def test_code_lengths_do_not_depend_on_the_table(monkeypatch):
    samples = {"a": ppm.fold("the cat sat on the mat and saw the dog " * 9), "b": ppm.fold("日本語のテキスト とても短い " * 7)}
    texts = [ppm.fold(t) for t in ("the dog saw", "日本 cat", "", "zzz qqq")]
    dense = ppm.Model(samples).bits(texts)
    monkeypatch.setattr(ppm, "DENSE_WIDTH", 0)
    searched = ppm.Model(samples)
    assert searched.row4 is None
    for x, y in zip(dense, searched.bits(texts), strict=True):
        assert np.array_equal(x, y)



def test_language_awkward_rows(spark):
    docs = awkward_documents(spark)
    rows = {r.doc_id: r for r in ppm.identify(docs, ppm.train(docs)).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and rows[0].score == 0
    assert ppm.identify(docs, ppm.Model({})).where("lang_pred <> 'und'").count() == 0
    none = empty_documents(spark)
    assert ppm.identify(none, ppm.train(none)).count() == 0
    assert ppm.keep_identified(docs, ppm.train(docs)).columns == docs.columns


def test_language_of_long_texts_only(spark):
    rng = random.Random(16)
    tongues = {"aa": "kalo mire suto bane liru".split(), "zz": "wexqu jyrrh vokk zhund ptafq".split()}
    long = [(i, " ".join(rng.choice(tongues["zz"]) for _ in range(500)), "zz") for i in range(8)]
    short = [(i, " ".join(rng.choice(tongues["aa"]) for _ in range(60)), "aa") for i in range(20, 40)]
    df = spark.createDataFrame(long + short + [(50, None, "zz")], "doc_id long, text string, lang string")
    model = ppm.train(df, train_bytes=1000)
    assert set(model.langs) == {"aa", "zz"}
    got = {r.doc_id: r.lang_pred for r in ppm.identify(df.where("text is not null"), model).collect()}
    assert got == {i: lang for i, _, lang in long + short}


# ---- 10 exact dedup


def test_exact_dedup(spark, sf, texts):
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in texts.items()}
    groups = defaultdict(list)
    for d, t in norm.items():
        groups[t].append(d)
    rows = queries.op10_exact_dedup(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        mine = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(mine), len(mine), r.doc_id == min(mine))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_exact_dedup_awkward_rows(spark):
    docs = awkward_documents(spark)
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == docs.count()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    for mine in groups.values():
        assert sum(r.kept for r in mine) == 1 and {r.group_size for r in mine} == {len(mine)}
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty_documents(spark)).count() == 0
    ids = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    assert Counter((r.doc_id, r.kept) for r in exact_dedup.exact_dedup(ids).collect()) == Counter({(None, False): 2, (3, True): 1, (None, True): 1})


# ---- twins and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(name, spark, sf, duck):
    from compare import duck_rows, spark_rows

    columns, rows = spark_rows(queries.QUERIES[name](spark, sf))
    other_columns, other = duck_rows(duck, queries.ORACLES[name])
    assert set(other_columns) <= set(columns)
    at = [columns.index(c) for c in other_columns]
    assert sorted((tuple(r[i] for i in at) for r in rows), key=repr) == other


def test_pipeline(spark, sf, documents, texts):
    import corpus_pipeline

    lang = {r.doc_id: r.lang_pred for r in ppm.identify(documents, ppm.train(documents)).where("score >= 0.5").collect()}
    left = documents.where(F.col("doc_id").isin(list(lang)))
    kept = {r.doc_id for r in quality.judge(left, quality.references(left)).where("kept").collect()}
    first = {}
    for d in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[d] or ""), d)
    classes = slow_classes([(d, texts[d]) for d in sorted(first.values())])
    heads = sorted(d for d, (_, c) in classes.items() if c == d)
    rows = corpus_pipeline.run(spark, sf).collect()
    used, least = check_packing(rows, [(d, texts[d]) for d in heads], 2048)
    assert used <= least * 1.02 + 3


def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline

    for docs in (awkward_documents(spark), empty_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            docs = out
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        check_packing(packed, [(r.doc_id, r.text) for r in docs.collect()], 2048) if packed else None
        assert sum(r.piece == 0 for r in packed) == docs.count()


def test_near_copies_without_or_with_shared_ids(spark):
    import corpus_pipeline

    rng = random.Random(17)
    a, b, c, d, e = (prose(rng, 80) + f" only{k}" for k in range(5))
    rows = [(None, a), (None, b), (None, b + " more"), (7, c), (7, d), (7, d), (9, e), (None, e + " more"), (8, c + " more")]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t), 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key int, `a.b` string")
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    one_of_b = [(None, t) for t in (b, b + " more") if (None, t) in got]
    assert len(one_of_b) == 1 and got[one_of_b[0]] == 1
    got.pop(one_of_b[0])
    assert got == Counter({(None, a): 1, (7, c): 1, (7, d): 2, (9, e): 1})
    kept = corpus_pipeline.near_copies(spark, corpus_pipeline.exact_copies(spark, docs, ""), "")
    packed = corpus_pipeline.best_fit(spark, kept, "").collect()
    assert kept.count() == 5 and packed


def test_pipeline_holds_little_memory(spark, monkeypatch):
    """Small batches in every stage, few files for small tables however many partitions there are, no encoders in workers that do other work."""
    import corpus_pipeline
    from chronoweave.llm import common

    files, plain = {}, common.Scratch.table

    def table(self, df, name, **options):
        out = plain(self, df, name, **options)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(common.Scratch, "table", table)
    rows = near_copies(random.Random(21), 14, 14)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    hard = {batch: "10000", "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in hard}
    try:
        for key, value in hard.items():
            spark.conf.set(key, value)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups.jaccard_classes(docs, wide=4).collect()}
        assert spark.conf.get(batch) == "10000"
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        awkward = awkward_documents(spark)
        for stage in (corpus_pipeline.language_id, corpus_pipeline.quality_rules, corpus_pipeline.near_copies, corpus_pipeline.best_fit):
            spark.conf.set(batch, "10000")
            stage(spark, awkward.limit(8), "")
            assert int(spark.conf.get(batch)) <= corpus_pipeline.ARROW_ROWS
        spark.conf.set(batch, "100")
        corpus_pipeline.language_id(spark, awkward, "")
        assert spark.conf.get(batch) == "100"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == slow_classes(rows)
    most = max(4, spark.sparkContext.defaultParallelism)
    assert {"links", "edges", "hooks", "labels", "hot", "found", "tried"} <= set(files)
    assert all(files[name] <= most for name in ("links", "edges", "hooks", "labels", "hot", "crowded", "tried", "found", "asked", "first", "rest", "inside") if name in files)
    bpe.encoder(TOKENS)
    common.let_go()
    assert not bpe._ENCODERS
    assert len(bpe.encoder(TOKENS).texts(["the harbour"])) == 1
