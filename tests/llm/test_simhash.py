import numpy as np
import xxhash

from vecharbor.llm import simhash


def plain(text):
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, ids):
    """Least id of each value's component by brute force."""
    n, label = len(values), list(range(len(values)))
    for i in range(n):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for k, i in zip(label, ids, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return [least.get(k) for k in label]


def test_fingerprint_matches_its_definition():
    for text in (b"", b" \t", b"a", b"A b", b"a b c", b"The cat SAT on the mat the cat sat", "é è \xa0 x".encode(), b"w " * 500):
        assert simhash.fingerprint(text) == plain(text)


def test_components_match_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    values, ids = [plain((r.text or "").encode()) for r in rows], [r.doc_id for r in rows]
    want = dict(zip(ids, zip(values, classes(values, ids), strict=True), strict=True))
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_trie_links_close_values_across_levels():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 6)), replace=False))) for b in base for _ in range(6)]
    values = np.unique(np.array([*base, *near], np.uint64))
    label = simhash.trie_links(values, np.zeros(len(values), np.int64))
    want = classes([int(v) for v in values], list(range(len(values))))
    assert [int(x) for x in np.unique(label, return_inverse=True)[1]] == [sorted(set(want)).index(w) for w in want]


def test_large_groups_are_dealt_again_without_losing_links(spark):
    rng = np.random.default_rng(6)
    base = 0x0123456789ABCDEF
    values = sorted({base ^ sum(1 << int(k) for k in rng.choice(64, 4, replace=False)) for _ in range(300)})
    signed = [(int(np.uint64(v).view(np.int64)),) for v in values]
    links = simhash.links(spark.createDataFrame(signed, "fp bigint"), group_limit=20)
    roots = {r.u: r.root for r in simhash.star_components(links).collect()}
    got = [roots.get(s[0], s[0]) for s in signed]
    want = classes(values, list(range(len(values))))
    assert len(set(got)) == len(set(want))
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(values)) for j in range(0, i, 7))


def test_hubs_and_chains_find_their_least_node(spark):
    """A hub with very many leaves, a hub that is the greatest of its component, and a chain."""
    hub = [(0, i) for i in range(1, 3000)]
    crown = [(i, 9_999) for i in range(4_000, 6_000)]
    chain = [(i + 1, i) for i in range(20_000, 20_040)]
    got = {r.u: r.root for r in simhash.star_components(spark.createDataFrame(hub + crown + chain + [(-5, -5)], "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(1, 3000)} | {i: 4_000 for i in [*range(4_001, 6_000), 9_999]} | {i: 20_000 for i in range(20_001, 20_041)}
    assert got == want


def test_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {3}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}


def test_one_row_of_each_component_stays(odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is not None, r.doc_id) for r in kept.collect())
    found = simhash._classes(simhash.with_fingerprints(odd), 4096).select("root").distinct().count()
    assert len(ids) == found
    assert [x for x in ids if x[1] in (1, 2, 3, 4, 5)] == [(True, 1), (True, 3)]
    assert sum(1 for x in ids if x[1] == 6) == 2


def test_copies_of_one_row_leave_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "REMEMBERED", 3)
    rows = [(None, "same text without an id")] * 90 + [(4, "one two three four")] * 200 + [(4, "quite another text here")] * 2 + [(i, f"own text {i * 7919} of {i * 104729} row") for i in range(10, 40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    kept = sorted((r.doc_id or -1, r.text) for r in simhash.one_of_each(frame).collect())
    assert kept == sorted({(i or -1, t) for i, t in rows})


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).count() == 0
