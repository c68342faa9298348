"""Spelling variants against brute force over all edits."""
import re
import zlib
from collections import Counter

import pytest

from cohortlens.llm import common, spelling as S

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, length=6, least=5):
    c: Counter = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            c[w] += len(w) >= length
    return {w: n for w, n in c.items() if n >= least}


def brute_variants(v, factor=5):
    letters = sorted({c for w in v for c in w})
    form, near = {}, {}
    for w in v:
        out = {w[:i] + w[i + 1:] for i in range(len(w))}
        out |= {w[:i] + a + w[i + 1:] for i in range(len(w)) for a in letters}
        out |= {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in letters}
        found = [x for x in out if x in v and x != w]
        near[w] = len(found)
        best = min(found, key=lambda x: (-v[x], x), default=None)
        form[w] = best if best and v[best] >= factor * v[w] else None
    want = {}
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        want[w] = (form[w], root, v[w], near[w], v[form[w]] if form[w] else None)
    return want


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.documents(spark, SF).collect()]
    want = brute_variants(brute_counts(rows))
    assert found(S.op13_spelling(spark, SF)) == want and any(w[0] for w in want.values())


@pytest.mark.parametrize("max_bytes", [S.MAX_BYTES, 256])
def test_small_vocabulary_in_one_pass_and_in_several(spark, max_bytes):
    v = {"aaaaaa": 5, "aaaaaaa": 30, "baaaaa": 25, "abaaaa": 25, "caaaaaa": 200, "aabaab": 4000, "aabaaab": 700,
         "aabaaabc": 100, "aabaaabcd": 20, "éclair": 9, "éclairs": 45, "eclair": 45, "ÿ" * 40: 6, "ÿ" * 41: 7, "x": 9, "": 5}
    v.update({f"word{chr(97 + i)}{chr(97 + j)}": 5 + i * j for i in range(26) for j in range(26)})
    df = spark.createDataFrame(list(v.items()), "word string, n long")
    assert found(S.variants(df, max_bytes=max_bytes)) == brute_variants(v)


def test_long_words_and_many_cells():
    words = ["ab" * 30_000, "abc"]
    got = [(i, len(w)) for i, w in S.edits(words, S.np.array([97, 98]), S.Filters({59_999: 1, 2: 1}, 1, 0))]
    assert got == []
    assert [int(h) for h in S.word_hash(S.np.array([[97, 98], [98, 97]]))] != [0, 0]


def test_counts_equal_brute_force_on_edges(spark, edge, nothing, frame, clash):
    rows = [(1, "Straße straße STRASSE naïve NAÏVE Naïve naïve naïve"), (2, "rabbits " * 300), (None, "rabbits rabbitx " * 7),
            (3, "x" * 5000 + " " + "y" * 6 + "1" + "y" * 6), (3, "yyyyyy×yyyyyy÷ yyyyyyy")] * 3
    df = frame([(i, t) for i, t in rows], **clash)
    got = {r["word"]: r["n"] for r in S.count_words(df).collect()}
    assert got == brute_counts(rows)
    kept = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert found(S.variants(S.count_words(edge))) == brute_variants(brute_counts(kept))
    assert S.variants(S.count_words(nothing)).count() == 0
