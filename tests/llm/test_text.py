"""Secrets, near-dedup, substring dedup, line dedup: brute force and edge cases."""
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import common, components, hyperminhash, line_dedup, secrets, suffix_dedup

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out)), Counter(k for _, k, _ in out)


def test_secret_spans_equal_brute_force(spark, frame, clash):
    rows = [(i, t) for i, t in enumerate([
        None, "", 'password = "hunter22" and token:abc', "TOKEN=token=abcdefgh", "\U0001f600 secret: s3cr3t_value AKIA" + "A1" * 9,
        "AKIA" + "Z" * 15, "AKIAKIA" + "Z" * 16, "f" * 23, "f" * 24 + " " + "0123456789abcdef" * 3, "api_key='a.b-c=d'api-key=zzzzzzz",
        'password=token"=abcdefgh', "secret" * 2000 + "=abcdef"])]
    out = {r["doc_id"]: r for r in secrets.find_secrets(frame(rows, **clash)).withColumn(
        "s", secrets._joined(F.col("base"))).collect()}
    for i, t in rows:
        s, n = base_spans(t)
        assert (out[i]["s"], out[i]["n_assign"], out[i]["n_access"], out[i]["n_hex"]) == (s, n[0], n[1], n[2]), t


def test_secret_query_keeps_base_and_counts_rows(spark):
    docs = common.documents(spark, SF).select("doc_id", "text").collect()
    out = {r["doc_id"]: r for r in secrets.op1_secret_scan(spark, SF).collect()}
    assert len(out) == len(docs)
    for d in docs:
        s, _ = base_spans(d["text"])
        got = [x for x in out[d["doc_id"]]["spans"].split(",") if x and not x.startswith("random")]
        assert ",".join(got) == s and out[d["doc_id"]]["base_sha256"] == hashlib.sha256(s.encode()).hexdigest()


def test_battery_reports_random_tokens_and_leaves_patterned_ones(spark, frame):
    rng = np.random.default_rng(5)
    chars = np.array(list(secrets.ALPHABETS["base64"][:62]))
    rows = [(i, "key " + "".join(rng.choice(chars, 40))) for i in range(60)]
    rows += [(100 + i, "path " + "Aa1" * 13 + "A") for i in range(60)]
    out = {r["doc_id"]: len(r["random"]) for r in secrets.find_secrets(frame(rows)).collect()}
    assert sum(out[i] for i in range(60)) >= 45 and not sum(out[100 + i] for i in range(60))


def test_secret_edges(edge, nothing):
    out = secrets.find_secrets(edge).collect()
    assert len(out) == 13 and not any(r["n_assign"] + r["n_access"] + r["n_hex"] for r in out)
    assert secrets.find_secrets(nothing).count() == 0


def shingles(text, words):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0d]+", low)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < words else frozenset(zip(*(w[i:] for i in range(words))))


def brute_components(rows, words, percent):
    sets = {i: shingles(t, words) for i, t in rows}
    at, parent = defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    both = Counter()
    for ids in at.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1:]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, base_words, copies, changes):
    rng = np.random.default_rng(seed)
    text = [f"w{x}" for x in rng.integers(0, 5000, base_words)]
    out = []
    for _ in range(copies):
        t = list(text)
        for j in rng.integers(0, base_words, changes):
            t[j] = f"z{rng.integers(0, 10 ** 6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(frame, words, percent):
    texts = near_copies(1, 200, 60, 3) + near_copies(2, 12, 10, 1) + near_copies(3, 400, 30, 9) + ["Same Text here"] * 5
    texts += [None, "", "  ", "a", "A", "a b", "b a", "x " * 5000] + near_copies(4, 60, 40, 2)
    rows = list(enumerate(texts))
    want = brute_components(rows, words, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in hyperminhash.near_duplicates(
        frame(rows, h=1, k=2, rep=3, component_id=4, kept=5), words, percent).collect()}
    assert got == want
    kept = hyperminhash.near_duplicates(frame(rows), words, percent).where("kept").count()
    assert kept == len({c for _, c in want.values()})


def test_near_duplicate_edges(edge, nothing):
    out = hyperminhash.near_duplicates(edge).collect()
    assert len(out) == 13 and all(r["kept"] for r in out)
    assert {r["component_id"] for r in out if r["doc_id"] is None} == {None}
    assert hyperminhash.near_duplicates(nothing).count() == 0


def test_registers_and_estimate_follow_the_jaccard_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2 ** 63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b = np.sort(pool[:2400]), np.sort(pool[600:])
    regs = hyperminhash.registers(np.concatenate([a, b]), np.array([2400, 2400]))
    est = hyperminhash.estimate(np.array([(regs[0] == regs[1]).mean()]), np.array([2400.0]), np.array([2400.0]))
    assert abs(est[0] - 1800 / 3000) < 0.16
    few = hyperminhash.registers(np.array([5], np.uint64), np.array([1]))
    assert len(set(few[0].tolist())) == 1  # every empty bucket borrows the only register


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 180)] + [(7, 7)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {out[i] for i in range(1, 41)} == {0} and {out[i] for i in range(101, 180)} == {100}


def brute_removed(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                cover[i:i + n] = True
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        out.append((len(b), int(cover.sum()), runs, kept))
    return out


@pytest.mark.parametrize("length,hot", [(40, 8192), (400, 8192), (43, 2), (400, 2), (400, 5)])
def test_substring_dedup_equals_brute_force(frame, length, hot):
    rng = np.random.default_rng(9)

    def text(n):
        return "".join(rng.choice(list("abcdefgh é "), n))

    passage = text(length + 30)
    texts = [text(900), passage, text(300) + passage + text(500), passage[:length], passage[1:length], "ab" * 700,
             text(100) + "ab" * length, None, "", text(700), passage + passage, "x" * (3 * length), text(2000)]
    texts += [texts[0], texts[9][:length - 1], "q" + texts[12][:-1]] + [text(50) + passage[5:] + text(50)] * 4
    want = brute_removed(texts, length)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in
           suffix_dedup.dedup_substrings(frame(list(enumerate(texts)), h=1, rid=2, marks=3), length, hot).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_substring_dedup_edges(frame, edge, nothing):
    out = suffix_dedup.dedup_substrings(edge).collect()
    assert len(out) == 13
    twice = [r for r in out if r["doc_id"] == 4]
    assert [r["n_removed"] for r in twice] == [r["n_bytes"] for r in twice] and len(twice) == 2
    assert not sum(r["n_removed"] for r in out if r["doc_id"] != 4) and not sum(r["n_shared"] for r in out)
    split = suffix_dedup.dedup_substrings(edge, hot=1).collect()
    assert sorted(split, key=repr) == sorted(out, key=repr)
    assert suffix_dedup.dedup_substrings(nothing).count() == 0


def held(rows, n):
    """Per row, whether another document (id and text) holds one of its strings of n words."""
    split = [re.findall(rb"[^ \t-\r]+", (t or "").encode()) for _, t in rows]
    own = [{tuple(w[i:i + n]) for i in range(len(w) - n + 1)} for w in split]
    holders = defaultdict(set)
    for row, strings in zip(rows, own):
        for x in strings:
            holders[x].add(row)
    return [any(len(holders[x]) > 1 for x in strings) for strings in own]


@pytest.mark.parametrize("words", [50, 20, 9])
def test_shared_words_lie_between_brute_forces(frame, words):
    rng = np.random.default_rng(12)

    def text(n, letters="abcdeé"):
        return "".join(f"{''.join(rng.choice(list(letters), rng.integers(1, 5)))}{rng.choice([' ', '  ', chr(10), chr(9)])}" for _ in range(n))

    passage = text(words)
    texts = [text(300), text(80) + passage + text(60), passage, " " + passage.replace("\n", " \t"), text(9) + passage[1:],
             text(40) + text(1).strip() + passage, passage + passage, None, "", "z" * 9000, "y " * 200, " y" * 260,
             text(3 * words), text(words - 1)]
    texts += [texts[0], texts[12][5:], texts[13]] + [f"{i} {passage} {i}" for i in range(30)]
    rows = [*enumerate(texts), (1, texts[1]), (1, texts[0]), (None, texts[12])]
    got = {(r["doc_id"], r["n_bytes"]): r["n_shared"] for r in suffix_dedup.dedup_substrings(
        frame(rows, h=1, rid=2, d=3, key=4, n_shared=5), words=words).collect()}
    sizes = [(i, len((t or "").encode())) for i, t in rows]
    sure, possible = held(rows, words), held(rows, max(1, words - words // 5))
    assert sum(sure) > 30 and not all(possible)
    for row, must, may in zip(sizes, sure, possible):
        assert got[row] > 0 if must else got[row] == 0 or may


def test_strings_of_hot_anchors_meet_once_per_task():
    rng = np.random.default_rng(3)
    passage = rng.bytes(200)
    texts = [rng.bytes(29) + bytes([i]) + passage + bytes([i]) + rng.bytes(29) for i in range(60)]  # edges differ
    blobs, n = {}, 50
    for part in (texts[:40], texts[40:59], texts[59:]):
        own = suffix_dedup.Strings()
        for t in part:
            at = np.array([len(t) - n])  # one anchor that decides on every string of the text
            own.add(t, texts.index(t), 0, at, np.array([0]), at, n)
        for b, blob in suffix_dedup.split_strings(own, 4, n):
            blobs.setdefault(b, []).append(blob)
    cut = {tuple(r) for own in blobs.values() for r in suffix_dedup.merge_strings(own, n).tolist()}
    for i in range(60):
        mine = np.zeros(260, bool)
        for _, _, s, e in (r for r in cut if r[0] == i):
            mine[s:e] = True
        assert mine[30:230].all() and mine.sum() == 200


def test_merge_of_front_coded_runs_is_the_sorted_order():
    rng = np.random.default_rng(2)
    words = sorted({bytes(rng.choice([97, 98], rng.integers(1, 12)).astype(np.uint8)) for _ in range(300)})
    for k in (1, 2, 3, 7):
        runs = [suffix_dedup.encode([(w, b"", 0, 0, [(1, 2, 3)]) for w in words[i::k]]) for i in range(k)]
        out = list(suffix_dedup.merge_runs(runs))
        assert [s for _, s, _ in out] == words
        assert all(p == suffix_dedup.shared_prefix(a, b, 0) for (p, b, _), a in zip(out[1:], words))


def brute_lines(rows):
    first, covered = {}, defaultdict(set)
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p:p + 3])
            if not re.search(r"\S", "".join(w)):
                continue
            if w in first:
                covered[i] |= {p, p + 1, p + 2}
            else:
                first[w] = (i, p)
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in covered[i]) for i, t in rows}


def test_line_dedup_equals_brute_force(frame, clash):
    rng = np.random.default_rng(4)
    rows = [(i, "\n".join(f"line {x}" for x in rng.integers(0, 12, rng.integers(1, 40)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, "it's\n'a'\n\\t\nit's\n'a'\n\\t")]
    out = line_dedup.dedup_lines(frame(rows, **clash))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_lines(rows)
    assert len(set(out.columns)) == len(out.columns) and out.where("rep <> 1").count() == 0


def test_line_dedup_edges(edge, nothing):
    out = line_dedup.dedup_lines(edge)
    assert out.count() == 13
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[8] == "l1\nl2\nl3\nl4" and text[9] == "" and text[1] is None
    assert line_dedup.dedup_lines(nothing).count() == 0


@pytest.mark.parametrize("kind,size", [("base64", 40), ("base36", 40), ("base36", 26), ("base32", 48)])
def test_few_planted_tokens_are_reported(frame, kind, size):
    letters = {"base64": secrets.ALPHABETS["base64"][:62]}.get(kind, secrets.ALPHABETS[kind])
    rng = np.random.default_rng(size)
    rows, i = [], 0
    while len(rows) < 5:
        t = "".join(rng.choice(list(letters), size).tolist())
        i += 1
        if any(c.isdigit() for c in t):
            rows.append((len(rows), f"see {t} there"))
    assert sum(len(r["random"]) for n in (1, 3) for r in secrets.find_secrets(frame(rows[:n])).collect()) >= 3
    assert sum(len(r["random"]) for r in secrets.find_secrets(frame(rows)).collect()) >= 4
    flat = [(k, f"see {'aaaa1111' * 6} abcdefghijklmnopqrstuvwxyz012345 there {k}") for k in range(5)]
    assert sum(len(r["random"]) for r in secrets.find_secrets(frame(flat)).collect()) == 0
