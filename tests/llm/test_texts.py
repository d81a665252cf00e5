"""Fingerprints, licenses, token counts, sharding, byte-pair encoding and pages."""

import hashlib
import html
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import Row
from pyspark.sql import functions as F

from vecharbor.llm import bpe, html_text, licenses, parsing, queries, sharding, token_counts


# ---- fingerprints ----


def test_equal_texts_have_equal_fingerprints_in_any_company():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["", "a", "aa", "aaaaaaaaaaaa", "😀é"]
    together = parsing.fingerprints(texts)
    for t, row in zip(texts, together, strict=True):
        assert (parsing.fingerprints([t])[0] == row).all()


def test_shared_parts_show_at_any_offset():
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    other = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    a, b, c = parsing.fingerprints([body, "xyz" + body, other])
    assert parsing.likeness(a[None], b[None])[0] > 0.8
    assert parsing.likeness(a[None], c[None])[0] < 0.1


def test_phrases_are_short_and_cover_the_text():
    x = np.array([ord(c) for c in "abracadabra " * 50], np.uint32)
    sizes = [len(n) for _, n, _ in parsing.parse(x, np.array([0]))]
    assert sizes[0] == len(x) and sizes[-1] == 1 and all(a > b for a, b in zip(sizes, sizes[1:], strict=False))


FULL = (1 << 64) - 1


def plain_mix(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> 33)) * factor & FULL
    return x ^ (x >> 33)


def plain_levels(text):
    """Names of a text's phrases, level by level, symbol by symbol."""
    x = [plain_mix(ord(c) + 1) for c in text]
    levels = [x]
    while True:
        runs = []
        for s in x:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        x = [s if n == 1 else plain_mix((s + plain_mix(n)) & FULL) for s, n in runs]
        label = x
        for _ in range(4):
            new = []
            for i, s in enumerate(label):
                differ = s ^ label[i - 1] if i else 1
                place = (differ & -differ).bit_length() - 1
                new.append(2 * place + (s >> place & 1))
            label = new
        assert all(a != b for a, b in zip(label, label[1:]))
        # A phrase starts at each local maximum; the last symbol starts none.
        cuts = [i for i in range(len(x)) if i == 0 or (i < len(x) - 1 and label[i - 1] < label[i] > label[i + 1])]
        names = []
        for a, b in zip(cuts, [*cuts[1:], len(x)]):
            total = sum(plain_mix(s ^ (k * 0xFF51AFD7ED558CCD & FULL)) for k, s in enumerate(x[a:b])) + (b - a)
            names.append(plain_mix(total & FULL))
        levels.append(names)
        if len(names) == 1:
            return levels
        x = names


def plain_fingerprint(text):
    """16-bit values of 64 bins: of the names of level 2 and above and the whole text's name, the least in each bin."""
    levels = plain_levels(text)
    least = [None] * 64
    for name in {n for at, names in enumerate(levels) if at >= 2 or (at and len(names) == 1) for n in names}:
        h = plain_mix(name)
        v = min(h >> 20 & 0xFFFFFFFF, 0xFFFFFFFE)
        if least[h >> 58] is None or v < least[h >> 58]:
            least[h >> 58] = v
    return [0xFFFF if v is None else min(v & 0xFFFF, 0xFFFE) for v in least]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c", min_size=1, max_size=40) | st.text(min_size=1, max_size=200))
def test_phrases_match_a_plain_parse(text):
    x = np.array([ord(c) for c in text], np.uint32)
    assert [names.tolist() for _, names, _ in parsing.parse(x, np.array([0]))] == plain_levels(text)
    assert parsing.fingerprints([text])[0].tolist() == plain_fingerprint(text)


def test_a_hot_id_is_dealt_over_buckets(spark):
    """Half of all rows under one id, many without an id: still each row beside the next."""
    rows = [(5, f"hot {i}") for i in range(200)] + [(None, f"none {i}") for i in range(90)] + [(i, f"own {i}") for i in range(-50, 60) if i != 5] + [(5, "hot 1"), (2**53 + 1, "far")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashed = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    want = Counter()
    for i, (doc_id, text) in enumerate(rows):
        want[doc_id, hashlib.sha256(parsing.edited(text, rows[(i + 1) % len(rows)][1]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in parsing.compared(frame, 8).collect()) == want
    sizes = [r["count"] for r in parsing.with_next(frame, 8).groupBy("bucket").count().collect()]
    assert max(sizes) < 90


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_edited_texts_match_brute_force(docs, buckets):
    rows = sorted(docs.select("doc_id", F.coalesce("text", F.lit(""))).collect(), reverse=True)
    got = {r.doc_id: r for r in parsing.compared(docs, buckets).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        one, two, three = parsing.fingerprints([text, changed, following])
        assert r.fingerprint == parsing.shown(one[None])[0] and r.edited_fingerprint == parsing.shown(two[None])[0]
        assert (r.near_edited, r.near_next) == (parsing.likeness(one[None], two[None])[0], parsing.likeness(one[None], three[None])[0])


def test_fingerprints_of_odd_rows(odd, none):
    assert parsing.compared(odd).count() == odd.count()
    assert parsing.compared(none).count() == 0
    single = parsing.compared(odd.where("doc_id = 7")).first()
    assert (single.near_next, single.n_chars) == (1.0, 1)


# ---- licenses ----


def test_licenses_match_sql(spark, sf_dir):
    same(spark, sf_dir, queries.op5_license_scans, queries.ORACLE_SQL["op5_license_scans"])


def test_decontamination_matches_sql(spark, sf_dir):
    same(spark, sf_dir, queries.op1_benchmark_decontamination, queries.ORACLE_SQL["op1_benchmark_decontamination"])


def plain_scan(rows, texts, size=5, least=0.8):
    """Licenses by containment in the windows of each distinct row, shingle by shingle."""
    out = {}
    known = {}
    for name, text in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        if grams:
            known[name] = grams, 1 << (len(grams) - 1).bit_length()
    for doc_id, text in {(d, t) for d, t in rows if t is not None}:
        w = re.split(r"[^0-9a-z\x80-\U0010ffff]+", text.lower())
        grams = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        for name, (wanted, s) in known.items():
            for k in range(-1, len(grams) // s + 1):
                at = [p for p in range(max(k * s, 0), min((k + 2) * s, len(grams))) if grams[p] in wanted]
                share = len({grams[p] for p in at}) / len(wanted)
                if share >= least:
                    best, first, n = out.get((doc_id, name), (0, 10**9, 0))
                    out[doc_id, name] = max(best, share), min(first, at[0]), n + 1
    return out


def test_scans_match_a_plain_scan(spark, odd, none):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(150))
    texts = licenses.TEMPLATES | {"long": long, "short": "too few words"}
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for i in range(120):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(3)]
        some = [rng.choice(list(texts.values())) for _ in range(2)]
        rows.append((rng.randint(100, 160), " ".join((parts[0], some[0], parts[1], some[1], parts[2]))))
    half = licenses.TEMPLATES["GPL-3.0-notice"].split()
    # Nulls, repeats, parts of one notice in rows of one id, and notices without an id.
    rows += [*rows[-5:], (None, licenses.TEMPLATES["MIT"]), (7, licenses.TEMPLATES["MIT"]), (7, None), (8, " ".join(half[:14])), (8, "x " * 14 + " ".join(half[14:]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("key", "h", "w", "ws", "s", "license"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = {(r.doc_id, r.license): (r.containment, r.first_word, r.n_windows) for r in licenses.scan(frame, texts).collect()}
    assert got == plain_scan(rows, texts)
    assert (8, "GPL-3.0-notice") not in got and (None, "MIT") in got and {n for _, n in got} >= {"long", "MIT"}
    assert licenses.scan(none).count() == 0 and licenses.scan(odd).count() == 0
    assert licenses.scan(frame, {"none": "too short"}).count() == 0


def test_bands_retrieve_as_promised(spark):
    """A template of one shingle, in windows full of other words: the worst case."""
    rng = random.Random(6)
    rows = [(i, " ".join((*(str(rng.random()) for _ in range(rng.randint(20, 40))), licenses.TEMPLATES["MIT"], *(str(rng.random()) for _ in range(40))))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = licenses.scan(frame, {"MIT": licenses.TEMPLATES["MIT"]}).count()
    assert got == 3000


def test_altered_and_repeated_notices(spark):
    texts = [(1, "x " * 500 + licenses.TEMPLATES["GPL-3.0"] + " y" * 500), (2, licenses.TEMPLATES["BSD-3-Clause"].replace("permitted", "allowed")), (2, None), (3, licenses.TEMPLATES["MIT"] * 3), (3, "Released under the MIT")]
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got[1, "GPL-3.0"].containment == 1.0 and got[1, "GPL-3.0"].first_word == 500
    assert (2, "BSD-3-Clause") not in got or got[2, "BSD-3-Clause"].containment >= 0.8
    assert (3, "MIT") in got


# ---- token counts ----


def test_suffix_sums(spark):
    lengths = [0, 0, 3, 3, 5, 130, 4000, 4000, 9000]
    hist = spark.createDataFrame(list(Counter(lengths).items()), "n_tokens bigint, n_docs bigint")
    sums = token_counts.suffix_sums(hist).cache()
    for r in sums.collect():
        over = [x for x in lengths if x >= r.n_tokens]
        assert (r.docs_at_least, r.tokens_at_least, r.docs_total, r.tokens_total) == (len(over), sum(over), len(lengths), sum(lengths))
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
        assert r.share_below == (len(lengths) - len(over)) / len(lengths)
    limits = [0, 1, 4, 4000, 10_000]
    got = token_counts.at_limits(hist, limits).collect()
    assert sorted(r.limit for r in got) == limits
    for r in got:
        assert (r.docs_over, r.tokens_kept) == (sum(x > r.limit for x in lengths), sum(min(x, r.limit) for x in lengths))
    ordered, shares = sorted(lengths), [0.1, 0.5, 1.0, 1 / 3]
    got = token_counts.quantiles(hist, shares).collect()
    assert sorted(r.share for r in got) == sorted(shares)
    for r in got:
        assert r.n_tokens == ordered[int(np.ceil(r.share * len(lengths))) - 1]


def test_report_answers_limits_and_quantiles(spark):
    rng = random.Random(3)
    lengths = [int(rng.expovariate(1 / 300)) for _ in range(997)] + [50_000] * 3
    hist = spark.createDataFrame(list(Counter(lengths).items()), "n_tokens bigint, n_docs bigint")
    got = {r.n_tokens: r for r in token_counts.report(hist).collect()}
    assert got.keys() == set(lengths) | set(token_counts.LIMITS) and {n for n, r in got.items() if r.is_limit} == set(token_counts.LIMITS)
    ordered = sorted(lengths)
    want = {}
    for share in token_counts.SHARES:
        want.setdefault(next(n for k, n in enumerate(ordered, 1) if k >= share * len(ordered)), []).append(share)
    assert {n: r.quantiles for n, r in got.items() if r.quantiles} == want
    for n, r in got.items():
        assert (r.n_docs, r.docs_over, r.tokens_over) == (lengths.count(n), sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        assert r.truncated_total == sum(min(x, n) for x in lengths)


def test_histogram_matches_the_library(spark, docs, sf_dir, odd, none):
    import public_tokenizers as public

    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    coder = token_counts._encoding(path, public.PATTERN)
    want = Counter(len(coder.encode_ordinary(r.text or "")) for r in docs.select("text").collect())
    got = {r.n_tokens: r.n_docs for r in queries.op7_token_counts(spark, sf_dir).collect() if r.n_docs}
    assert got == want
    assert token_counts.histogram(odd, path, public.PATTERN).agg(F.sum("n_docs")).first()[0] == odd.count()
    assert token_counts.suffix_sums(token_counts.histogram(none, path, public.PATTERN)).count() == 0
    assert token_counts.report(token_counts.histogram(none, path, public.PATTERN)).count() == 0


# ---- sharding ----


def plain_table(names, slots):
    import xxhash

    order = [[(xxhash.xxh64_intdigest(n, 1) % slots + j * (xxhash.xxh64_intdigest(n, 2) % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    owner, at = [None] * slots, [0] * len(names)
    while None in owner:
        for k in range(len(names)):
            if None not in owner:
                break
            while owner[order[k][at[k]]] is not None:
                at[k] += 1
            owner[order[k][at[k]]] = k
    return owner


def test_table_matches_brute_force_and_moves_little():
    names = [f"s{i}" for i in range(7)]
    assert sharding.table(names, 211).tolist() == plain_table(names, 211)
    full, less = sharding.table(names, 5003), sharding.table(names[:-1], 5003)
    size = np.bincount(full)
    assert size.max() - size.min() <= 1
    stayed = (full == less)[full < 6].mean()
    assert stayed > 0.85
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError, match="distinct"):
            sharding.table(bad, 211)
    with pytest.raises(ValueError, match="prime"):
        sharding.table(["a"], 12)


def test_placement(spark, sf_dir, odd, none):
    got = queries.op8_sharding(spark, sf_dir).cache()
    owner = sharding.table([f"shard-{i:05d}" for i in range(sharding.SHARDS)])
    assert all(owner[r.slot] == r.shard for r in got.collect())
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert sharding.placed(odd, "doc_id").count() == odd.count() and sharding.placed(none, "doc_id").count() == 0
    assert sharding.placed(odd, "doc_id", "text", shards=["a", "b"]).select("shard").distinct().count() == 2


# ---- byte-pair encoding ----


@pytest.fixture(scope="module")
def coders():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    return bpe.Encoder(path), Tokenizer.from_file(path)


def check(coders, text):
    mine, theirs = coders
    ids, decoded = mine.encode(text)
    want = theirs.encode(text, add_special_tokens=False).ids
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
    assert decoded == theirs.decode(want, skip_special_tokens=False) == mine.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aé'sdLl tΣİ<|endof>12½\x85  ", max_size=40))
def test_encoding_matches_the_library(coders, text):
    check(coders, text)


def test_capitals_whose_lower_case_lies_beyond_the_latin_range(coders):
    capitals = [chr(c) for c in range(0xC0, 0x250) if any(ord(x) > 0x24F for x in chr(c).lower())]
    assert len(capitals) == 24
    for c in capitals:
        check(coders, f"said {c}liyev, a{c}b {c} {c}{c}1")
    check(coders, "İlham Əliyev said hello")


def test_encoding_of_whole_documents(coders, docs, odd):
    for frame in (docs, odd):
        for r in frame.select("text").collect():
            check(coders, r.text or "")


def test_encoded_rows(odd, none):
    path = queries.vocabulary()
    got = bpe.encoded(odd, path).collect()
    assert len(got) == odd.count() and bpe.encoded(none, path).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (3, 4, 5)} == {(0, empty, empty)}
    row = bpe.with_tokens(odd.where("doc_id = 7"), path).first()
    assert row.decoded == "a</w>" and len(row.ids) == 1


# ---- pages ----

PAGE = "<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='box'>{box}</div><article><h1>Head {i}</h1><p>Body&nbsp;{i}  of\n<b>page</b> &amp; more<p>Second {i}</article><section class=comments><p>reader {i}</p></section><footer>foot</footer></body></html>"


def test_articles_without_their_surroundings(spark):
    rows = [(i, "http://h.example/x", PAGE.format(i=i, box="same on each page")) for i in range(20)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all(r.text == f"Head {r.page_id}\nBody {r.page_id} of page & more\nSecond {r.page_id}" and r.n_chars == len(r.text) for r in got)


def test_repeated_boxes_are_found_by_the_tree(spark):
    page = "<body><div class=q>All pages say this</div><div class=r><p>Only page {i} says so, at some length</div></body>"
    rows = [(i, f"http://h{i % 2}.example/{i}", page.format(i=i)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert html_text.decided_nodes(pages).where("low").count() == 2
    got = html_text.main_text(pages).collect()
    assert all(r.text == f"Only page {r.page_id} says so, at some length" for r in got)


MARKUP = re.compile(r"(?i)(</?)(?:article|main|nav|aside|footer|header|form)\b")


def article(source):
    """Blocks of the one article of a given page."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_entropies_alone_find_the_articles(spark):
    """Without any telling name, the tree still parts articles from menus, adverts and footers; an empty tree does not."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    plain = spark.createDataFrame([(r.page_id, r.url, MARKUP.sub(r"\1div", r.html).replace('class="ad"', 'class="q"')) for r in pages.collect()], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_text(plain).collect()} == want
    assert not any(html_text.Page(r.html).text() == want[r.page_id] for r in plain.collect())
    assert {r.page_id: r.text for r in html_text.main_text(pages).collect()} == want


def test_importance_matches_a_plain_computation(spark):
    """Both entropies of each node, page by page."""
    log, pages = np.log, spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    pages += [Row(page_id=i, url="http://a/", html=f"<div><div>same here</div><div><ul><li>own {i}; all of it</ul>{'<span>x</span>' * (i % 3)}</div></div>") for i in range(12)]
    clauses, styles, inner, m = {}, {}, {}, Counter()
    for p in pages:
        features, known = html_text.Page(p.html).features()
        for path, kind, feature in features:
            if kind == 2:
                m[path] += 1
                inner.setdefault(path, set()).update({path})
                for up in known[path][1]:
                    inner.setdefault(up, set()).add(path)
            else:
                (styles if kind else clauses).setdefault(path, Counter())[feature] += 1
    rows = spark.createDataFrame([(p.page_id, p.url, p.html) for p in pages], "page_id bigint, url string, html string")
    counts = html_text._statistics(rows).groupBy("path", "kind", "feature").agg(F.sum("n").alias("n"), F.max("named").alias("named"), F.max("up").alias("up"))
    got = {r.path: r for r in html_text.importance(counts, "path").collect()}
    assert got.keys() == m.keys()
    for path, r in got.items():
        n = m[path]
        # Entropy over pages of a clause that k pages have, each with probability 1/k.
        each = [-sum(1 / k * log(1 / k) for _ in range(k)) for at in inner[path] for k in clauses.get(at, {}).values()]
        mean = np.mean(each) if each else log(n)
        if n > 1:
            content = 1 - mean / log(n)
            presentation = -sum(k / n * log(k / n) for k in styles[path].values()) / log(n)
            leaf = set(styles[path]) == {0}
            assert r.importance == pytest.approx(content if leaf else 0.1 * presentation + 0.9 * content)
        assert r.m == n and r.repeats == pytest.approx(np.exp(mean))


def test_entropies_come_before_names(spark):
    """A branch of proven worth stays whatever it is called; where the tree says nothing, names decide."""
    page = "<body><div class='promo'><p>Story {i} tells its own tale, number {i}</p></div><div class=x>All pages say this</div></body>"
    rows = [(i, f"http://h{i % 2}.example/{i}", page.format(i=i)) for i in range(120)]
    make = lambda some: spark.createDataFrame(some, "page_id bigint, url string, html string")
    assert all(r.text == f"Story {r.page_id} tells its own tale, number {r.page_id}" for r in html_text.main_text(make(rows)).collect())
    assert [r.text for r in html_text.main_text(make(rows[:1])).collect()] == ["All pages say this"]
    readers = [(i, "http://h/", f"<body><div><p>Story {i}</div><div class=comments>Reader {i} says {i}</div>") for i in range(120)]
    assert all(r.text == f"Story {r.page_id}" for r in html_text.main_text(make(readers)).collect())


def test_tree_decides_inside_and_outside_articles(spark):
    page = "<body><div class=q>All pages say this</div><div class=r><p>Own body {i} of this page, at some length</div><article class=x>Read this next</article><section class=z><p>More body {i}</section></body>"
    split = "<body><article><p>First part {i} of the page</article><div class=more><p>Second part {i} of the page</div></body>"
    rows = [(i, f"http://h{i % 2}.example/{i}", page.format(i=i)) for i in range(40)]
    rows += [(i, f"http://s{i % 2}.example/{i}", split.format(i=i)) for i in range(40, 60)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    want = {i: f"Own body {i} of this page, at some length\nMore body {i}" if i < 40 else f"First part {i} of the page\nSecond part {i} of the page" for i in range(60)}
    assert {r.page_id: r.text for r in got} == want


def test_many_nodes_are_joined_by_page(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}.example/x", f"<div class=q>same</div><div class=promo>own {i} text</div><ul><li>menu</ul>") for i in range(240)]
    rows += [*rows[:5], (None, None, None), (1, "http://h1.example/x", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    key = lambda r: (r.page_id is None, r.page_id, r.text)
    want = sorted(html_text.main_text(pages).collect(), key=key)
    monkeypatch.setattr(html_text, "BROADCAST_NODES", 0)
    assert sorted(html_text.main_text(pages).collect(), key=key) == want
    assert [sum(r.text == f"own {i} text" for r in want) for i in (3, 30)] == [2, 1]


def test_odd_pages(spark):
    rows = [(None, None, None), (1, "", ""), (1, "no url", "<p>a<p>b"), (2, "http://x/", "<article></article><p>outside"), (3, "http://x/", "a < b &lt; <!-- <p>c"), (4, "http://x/", "<script>if (a<b) '</p>'</script>z<style>q"), (5, "http://x/", "<div>" * 3000 + "deep"), (6, "http://x/", "<p>" + "w " * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("low", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = [(r.page_id, r.text) for r in html_text.main_text(pages).collect()]
    assert {t for i, t in got if i is None} == {""} and ("a\nb" in [t for i, t in got if i == 1])
    by = {i: t for i, t in got if i and i > 1}
    assert (by[2], by[3], by[4], by[5], len(by[6])) == ("outside", "a < b <", "z", "deep", 599_999)
    assert html_text.main_text(pages.where("false")).count() == 0
