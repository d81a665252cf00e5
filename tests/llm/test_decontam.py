import hashlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vecharbor.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items):
    doc, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(str(name))
    return len(doc), len(hit), sorted(names)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and then runs far away from here today"),
    (2, "short item"),
    (10, "one"),
    (3, ""),
    (4, None),
    (None, "quick brown"),
    (5, "a a a a a a a a a a a a a a a"),
    (6, "The quick brown fox jumps over the lazy dog and then runs far away from here today"),
    (7, "Ä-ö ß123 x"),
    (8, " ".join(f"k{i % 37}" for i in range(120))),
]
TEXTS = [
    "He said: THE QUICK, brown fox jumps over the lazy dog and then runs far; away",
    "the quick brown fox jumps over the lazy dog and then runs close",
    "short  item! short item",
    "a " * 40,
    "a " * 12,
    "one " + "b " * 30,
    "one " + "b " * 10,
    "Ä ö ß123 X Ä-ö",
    " ".join(f"k{i % 37}" for i in range(20, 60)) + " z" * 500,
    " ".join(f"k{i}" for i in range(12)),
    "",
    None,
]


@pytest.fixture(scope="module")
def pair(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("width", F.lit("clash"))
    return docs, items


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 40, 5])
def test_matches_brute_force_in_one_block_or_many(pair, block):
    docs, items = pair
    known = [x for x in ITEMS if x[0] is not None]
    out = decontam.contamination(docs, items, block_words=block).withColumn("sha", decontam.items_sha256(F.col("items")))
    got = {r.doc_id: r for r in out.collect()}
    for i, text in enumerate(TEXTS):
        n, hit, names = plain(text, known)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items) == (n, hit, len(names), names)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        assert r.sha == hashlib.sha256(",".join(names).encode()).hexdigest()
    clean = {r.doc_id for r in decontam.clean_rows(docs, items, block_words=block).collect()}
    assert clean == {i for i in got if not got[i].contaminated}


def test_odd_rows_and_empty_tables(pair, odd, none):
    items = pair[1]
    assert decontam.contamination(odd, items).count() == odd.count()
    assert decontam.clean_rows(odd, items).columns == odd.columns
    assert decontam.contamination(none, items).count() == 0
    assert decontam.contamination(odd, items.where("false")).where("contaminated OR n_items > 0").count() == 0
    assert decontam.clean_rows(odd, items.where("false")).count() == odd.count()


def test_a_large_benchmark_stays_within_the_drivers_memory(spark):
    """Two million words, most of them distinct, in blocks: 400 MB at most for the driver's Python."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from vecharbor.llm import decontam
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rng = np.random.default_rng(1)
for block in range(4):
    items = [(str(i), " ".join(map(str, rng.integers(0, 300_000, 1000))).encode()) for i in range(500)]
    w = decontam.build_windows(items)
    assert len(w.words) == 500 * 988
    decontam.choose_prefixes(w, {k: rng.integers(0, 9, len(c)) for k, c in w.codes.items()})
    mask, found = decontam.hits(w, b"zero " .split() + items[3][1].split()[5:40])
    assert mask[1:].all() and not mask[0] and len(found) == 23
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=str(Path(__file__).resolve().parents[2]), check=True)
    assert int(done.stdout) < 500
