"""The operators against brute force on small tables with the awkward cases in them."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from setloom.llm import byte_bpe, chat_format, decontaminate, jaccard_join, license_scan, pii, quality_classifier, quality_rules, suffix_dedup, suffix_tree_lm

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, spans int, keys double"


def texts():
    rng = random.Random(11)
    syllables = "th er ion an re ing nd ha é ou ç le".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    out = []
    for _ in range(60):
        out.append(" ".join(word() for _ in range(rng.randint(1, 160))))
    passage = " ".join(word() for _ in range(60))
    for k in range(12):  # near copies and shared passages
        w = out[k].split()
        if len(w) > 3:
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
        out.append(f"{word()} {passage} {word()} {word()}")
    long = (out[5] + " " + passage + "\n") * 40
    return [*out, out[3], out[3], long, long + "end", None, "", "   \n ", "a", "x y", "x y", "y x", "Aé" * 300, "same line\n" * 80, "ab" * 4000, "the the the the the"]


@pytest.fixture(scope="module")
def rows():
    found = [(k * 3 % 131, t) for k, t in enumerate(texts())]
    return [*found, found[0], found[0], (None, found[1][1]), (None, None), (7, "another text of id seven, released under the MIT\nlicense")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 5 else None, 0, "w", 1, 0.5) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_license_scan(spark, docs, nothing, rows):
    texts = ["under the MIT License; under the mit\nlicense", "Apache License, Version 2.0", "cc by-nc 4.0", "Permission is hereby granted free of charge to any person obtaining one copy of this software and associated documentation files"]
    more = docs.unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(texts)], "doc_id bigint, text string"), allowMissingColumns=True)
    got = license_scan.scan(more).collect()
    assert len(got) == len(rows) + 4
    found = {r.doc_id: r for r in got}
    assert [(m.label, m.first_word) for m in found[1000].matches if m.phrase] == [("mit", 0), ("mit", 4)]
    assert {m.label for m in found[1001].matches if m.phrase} == {"apache-2"} and {m.label for m in found[1002].matches if m.phrase} == {"cc-by-nc"}
    assert {m.label for m in found[1003].matches} == {"mit"} and not any(m.phrase for m in found[1003].matches)
    assert any(m.phrase for r in got if r.doc_id == 7 for m in r.matches)
    assert license_scan.scan(nothing).count() == 0


def test_license_join_finds_all_that_brute_force_finds():
    rng = random.Random(5)
    words = sorted(license_scan.Index(license_scan.TEMPLATES, license_scan.PHRASES, 0.8, {}).order)
    for n in range(300):
        # any frequencies give an order, and any order must find the same
        index = license_scan.Index(license_scan.TEMPLATES, license_scan.PHRASES, (0.8, 0.6)[n % 2], {w: rng.randint(0, 9) for w in words} if n % 3 else {})
        vocabulary = sorted(index.order)
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        label, seq, own, need, phrase, step = rng.choice(index.entries)
        at = rng.randint(0, len(words))
        names = {v: k for k, v in index.order.items()}
        words[at:at] = [names[x] for x in seq]
        want = {(x[0], s) for x in index.entries if x[4] for s in range(len(words)) if [index.order[w] for w in words[s : s + len(x[1])]] == x[1]}
        found = index.matches(words)
        assert {(m[0], m[2]) for m in found if m[1]} == want
        assert label in {m[0] for m in found}
        blocks = {x[0] for x in index.entries if not x[4] for b in range(0, len(words), x[5]) if len({index.order[w] for w in words[b : b + 2 * x[5]]} & set(x[2])) >= x[3]}
        assert {m[0] for m in found if not m[1]} == blocks


def test_classifier_learns_and_shrinks(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["fine", "plain", "calm", "idiot" if k % 4 == 0 else "kind"], k=30)), "p", "big" if k % 3 else None, 0) for k in range(400)] + [(None, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(0, 400, 2)], "doc_id bigint, quality int, toxic int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == 401
    held = [r for r in got if r.doc_id is not None and r.doc_id % 2]
    assert all(r.kept for r in held)
    assert not any(r.kept for r in got if r.doc_id is not None and r.doc_id % 4 == 0)
    assert len(quality_classifier.classify(docs, labels.limit(0)).collect()) == 401
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def plain_classifier(rows, labels):
    """Posteriors of (doc_id, text, path, host) rows by the module's definition, row by row."""
    worst = {}
    for i, q, t in labels:
        if i is not None:
            bad, toxic = worst.get(i, (0, 0))
            worst[i] = (bad | int(q == 0), toxic | int(t == 1))
    total, evidence = len(worst), []
    for k in range(2):
        ones = sum(x[k] for x in worst.values())
        prior, n, c = math.log((ones + 0.5) / (total - ones + 0.5)), Counter(), Counter()
        for i, t, _, _ in rows:
            if i in worst:
                n.update(f := quality_classifier.features(t or ""))
                c.update(f if worst[i][k] else ())
        weights = {}
        for f, m in n.items():
            if m >= 5 and 0 < ones < total:
                e = m * ones / total
                if (c[f] - e) ** 2 / e + (c[f] - e) ** 2 / (m * (total - ones) / total) >= 30:
                    weights[f] = math.log((c[f] + 0.5) / (ones + 1) / ((m - c[f] + 0.5) / (total - ones + 1)))
        evidence.append([max(-20.0, min(20.0, prior + sum(weights.get(f, 0.0) for f in (quality_classifier.features(t) if t else ())))) for _, t, _, _ in rows])
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def strength(groups):  # (n, s, rate above)
        n = sum(g[0] for g in groups)
        if len(groups) < 2:
            return 1e6
        between = (sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) - sum(g[2] * (1 - g[2]) for g in groups)) / n
        return 1e6 if between <= 1e-12 else min(1e6, max(1.0, sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n / between - 1))

    out = []
    for scores in evidence:
        p = [sigmoid(x) for x in scores]
        mean = min(1 - 1e-6, max(1e-6, sum(p) / len(p)))
        hosts, paths = {}, {}
        for (_, _, path, host), x in zip(rows, p):
            for groups, key in ((hosts, host), (paths, (host, path))):
                a, b = groups.get(key, (0, 0.0))
                groups[key] = (a + 1, b + x)
        top = strength([(a, b, mean) for a, b in hosts.values()])
        rate = {h: (b + top * mean) / (a + top) for h, (a, b) in hosts.items()}
        low = strength([(a, b, rate[h]) for (h, _), (a, b) in paths.items()])
        final = []
        for (_, _, path, host), e, x in zip(rows, scores, p):
            a, b = paths[host, path]
            rest = min(1 - 1e-6, max(1e-6, (b - x + low * rate[host]) / (a - 1 + low)))
            final.append(sigmoid(e + math.log(rest / (1 - rest)) - math.log(mean / (1 - mean))))
        out.append(final)
    return list(zip(*out))


def test_classifier_equals_plain_python(spark, monkeypatch):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(300):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        t = " ".join(rng.choices(words + ["junk"] * 20 * bad + ["vile"] * 15 * toxic, k=rng.randint(1, 60)))
        rows.append((k, t, rng.choice(("a", "b", None)), "hot" if k % 3 else rng.choice(("x", "y", None)), bad, toxic))
    plain = [r[:4] for r in rows] + [(None, None, None, None), (300, None, "a", "x"), (301, "", "b", "hot"), (302, "vile " * 50_000, "a", "hot"), rows[5][:4]]
    labels = [(r[0], int(not r[4]), int(r[5])) for r in rows if r[0] % 2] + [(1, 0, 0), (None, 0, 1), (9999, 1, 0), (3, None, None)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in plain], "doc_id bigint, text string, lang string, source string, n bigint, host string").drop("n")
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = sorted((str(r[0]), str(r[3]), round(a, 6), round(b, 6)) for r, (a, b) in zip(plain, plain_classifier(plain, labels)))
    for most in (200_000, 0):  # rates broadcast, and dealt over salts
        monkeypatch.setattr(quality_classifier, "BROADCAST_RATES", most)
        got = quality_classifier.classify(docs, table).collect()
        assert sorted((str(r.doc_id), str(r.host), round(r.p_bad, 6), round(r.p_toxic, 6)) for r in got) == want


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>", "<\\|turn|>", "<\\\\|done|>x", "a<|more|>", "<", "\\", None, "", "é<|says|>\n", "[/INST]" * 3, "<<SYS>>"]
    rows = [(1, k, ("user", "assistant", "assistant", None)[k % 4], t) for k, t in enumerate(nasty)] + [(2, 0, "a<|says|>", "x"), (2, 0, "a<|says|>", "x"), (None, 1, "assistant", "y")]
    rows += [(3, k, "assistant" if k % 3 else "user", f"t{k}") for k in range(700)]
    made = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.conv_id: r for r in chat_format.parse_conversations(made).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    assert [(t.role, t.text) for t in got[2].turns] == [("a<|says|>", "x")] * 2
    for c in (1, None, 3):
        assert got[c].loss_text == "".join(r[3] or "" for r in rows if r[0] == c and r[2] == "assistant")
    body = got[1].formatted
    assert not re.search(r"</s>|\[/?INST\]|<<SYS>>", body)
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def plain_tree(texts, depth, gain):
    """P(symbol | bytes before) of a probabilistic suffix tree, from dictionaries."""
    windows = []
    for t in texts:
        s = [suffix_tree_lm.START] * depth + list(t) + [suffix_tree_lm.END]
        windows += [tuple(s[i - depth : i + 1]) for i in range(depth, len(s))]
    c = [Counter(w[depth - d :] for w in windows) for d in range(depth + 1)]
    n = [Counter(w[depth - d : depth] for w in windows) for d in range(depth + 1)]
    after = [Counter(w[:-1] for w in c[d]) for d in range(depth + 1)]
    states = {s for s in n[1]}
    for d in range(2, depth + 1):
        gains = Counter()
        for w, k in c[d].items():
            gains[w[:-1]] += k * math.log(k / n[d][w[:-1]] * n[d - 1][w[1:-1]] / c[d - 1][w[1:]])
        states.update(s[d - k :] for s, g in gains.items() if g >= gain for k in range(2, d + 1))

    def p(s, a):
        if not s:
            return (c[0][(a,)] + 0.5) / (len(windows) + 128)
        if s not in states:
            return p(s[1:], a)
        d = len(s)
        return (c[d][s + (a,)] + after[d][s] * p(s[1:], a)) / (n[d][s] + after[d][s])

    def score(t):
        s = [suffix_tree_lm.START] * depth + list(t) + [suffix_tree_lm.END]
        return sum(math.log10(p(tuple(s[i - depth : i]), s[i])) for i in range(depth, len(s)))

    return score


@pytest.mark.parametrize("salted,chunk", [(4096, 2_000_000), (1, 500)])
def test_language_model(spark, docs, rows, nothing, monkeypatch, salted, chunk):
    monkeypatch.setattr(suffix_tree_lm, "BATCH", 20_000)
    monkeypatch.setattr(suffix_tree_lm, "SALTED", salted)
    monkeypatch.setattr(suffix_tree_lm, "CHUNK", chunk)
    got = suffix_tree_lm.score_documents(docs, depth=4, gain=3.0, least_word=0.02).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    words = lambda t: [*(t or "").encode().lower().split(), b" "]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
    want = sorted((str(i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(base(t), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    tree = plain_tree([(t or "").encode().lower() for i, t in rows if not held(i)], 4, 3.0)
    want = sorted((str(i), len(words(t)), tree((t or "").encode().lower()), len((t or "").encode()) + 1) for i, t in rows)
    found = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    # log probabilities are sent in 16 bits: 0.00006 times the root of each is the most that one is off
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) <= 7e-5 * math.sqrt(b[3] * abs(b[2])) for a, b in zip(found, want))
    if chunk != 500:
        assert suffix_tree_lm.score_documents(nothing).count() == 0


def test_words_of_a_batch_are_counted_without_python_objects():
    texts = [b"", b"  \t", b"a b a", b"\x1ca\x0b\x0cb\n", "\u00a0x \u2003 é".encode(), b"a"]
    words, number, each = suffix_tree_lm.text_words(b"".join(texts), np.array([len(t) for t in texts]))
    want = [[*t.split(), b" "] for t in texts]
    assert each.tolist() == [len(w) for w in want]
    assert words.take(suffix_tree_lm.pa.array(number)).to_pylist() == sum(want, []) and len(set(words.to_pylist())) == len(words)
    words, number, each = suffix_tree_lm.text_words(b"", np.array([0]))
    assert words.to_pylist() == [b" "] and number.tolist() == [0] and each.tolist() == [1]


@pytest.mark.parametrize("waiting", [1, 300, 4_000_000])
def test_windows_are_sorted_once_and_scored_by_slots(monkeypatch, waiting):
    """Whatever is sorted at once; slots that several windows share, and the largest step, are told apart."""
    monkeypatch.setattr(suffix_tree_lm, "SORTED", waiting)
    monkeypatch.setattr(suffix_tree_lm, "CHUNK", 170)
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"abcdefgh", k=rng.randint(0, 400))) for _ in range(30)] + [b"", b"x"]
    training = np.array([rng.random() < 0.7 for _ in texts])
    plain = [[int.from_bytes((b"\xfe" * 7 + t + b"\xff")[k : k + 8], "big") for k in range(len(t) + 1)] for t in texts]
    raw, sizes = b"".join(texts), np.array([len(t) for t in texts])
    codes, counts = suffix_tree_lm.distinct_windows(raw, sizes, training, 7)
    learnt = Counter(x for t, learns in zip(plain, training) if learns for x in t)
    assert codes.tolist() == sorted({x for t in plain for x in t}) and counts.tolist() == [learnt[x] for x in codes.tolist()]
    steps = np.array([rng.choice((0, 5, 40_000, 65_535)) for _ in codes], np.uint16)
    value = dict(zip(codes.tolist(), (-((steps / suffix_tree_lm.STEPS) ** 2)).tolist()))
    got = suffix_tree_lm.text_scores(raw, sizes, 7, codes, steps)
    assert np.allclose(got, [sum(value[x] for x in t) for t in plain], rtol=1e-12)


def test_windows_of_a_batch_fit_a_worker():
    """Two workers share with their JVM what an executor may take: a whole batch takes each of them little."""
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(2, 9, 20_000)]
    raw = b" ".join(words[i] for i in (20_000 * rng.random(2_500_000) ** 12).astype(int).tolist())[: suffix_tree_lm.BATCH]
    sizes = np.full(1000, len(raw) // 1000)
    raw = raw[: sizes.sum()]
    tracemalloc.start()
    try:
        codes, counts = suffix_tree_lm.distinct_windows(raw, sizes, np.arange(1000) % 10 > 0, 6)
        kept, windows = tracemalloc.get_traced_memory()
        tracemalloc.reset_peak()
        suffix_tree_lm.text_scores(raw, sizes, 6, codes, (codes % np.uint64(30_000)).astype(np.uint16))
        scores = tracemalloc.get_traced_memory()[1] - kept
    finally:
        tracemalloc.stop()
    assert len(raw) > 0.99 * suffix_tree_lm.BATCH and len(codes) > 1_000_000 and counts.sum() == 0.9 * (len(raw) + 1000)
    assert windows < 100e6 and scores < 80e6


def test_tree_is_a_distribution():
    """All 256 symbols after any context, seen or not, sum to one."""
    raw, sizes = b"ababababababcabcbbbb" * 5, np.array([40, 30, 30])
    codes, counts = suffix_tree_lm.distinct_windows(raw, sizes, np.array([True, True, False]), 3)
    pairs = Counter()
    for code, n in zip(codes.tolist(), counts.tolist()):
        pairs[code & 0xFFFF] += n
    shallow, known = suffix_tree_lm.Shallow(pairs), dict(zip(codes.tolist(), counts.tolist()))
    for context in (b"bab", b"zzz", b"xab", b"\xfe\xfe\xfe"):
        head = int.from_bytes(context, "big") << 8
        every = np.array(sorted({*known, *(head | a for a in range(256))}), np.uint64)
        p = 10 ** suffix_tree_lm.bucket_tree(every, np.array([known.get(x, 0) for x in every.tolist()]), 3, shallow, 0.1)
        assert abs(p[every >> np.uint64(8) == head >> 8].sum() - 1) < 1e-9


def test_tree_grows_with_the_corpus():
    """Every context of the training texts is a candidate, however rare beside the whole."""
    rng = random.Random(12)
    filler = "".join(rng.choices("abcdefgh ", k=200_000)).encode()
    raw = filler + b"zqxj " * 12
    codes, counts = suffix_tree_lm.distinct_windows(raw, np.array([len(filler), 60]), np.ones(2, bool), 3)
    pairs = Counter()
    for code, n in zip(codes.tolist(), counts.tolist()):
        pairs[code & 0xFFFF] += n
    p = dict(zip(codes.tolist(), suffix_tree_lm.bucket_tree(codes, counts, 3, suffix_tree_lm.Shallow(pairs), 10.0).tolist()))
    assert p[int.from_bytes(b"zqxj", "big")] > math.log10(0.8)


def test_decontamination(spark, docs, nothing):
    item = "one two three four five six seven eight nine ten eleven twelve"
    swapped = "seven eight nine ten eleven twelve and one two three four five six"
    more = docs.unionByName(spark.createDataFrame([(500, f"x {item} y"), (501, swapped), (502, "one two three four"), (503, "zz"), (503, "zz")], "doc_id bigint, text string"), allowMissingColumns=True)
    items = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "zz", 0)], "item_id bigint, text string, doc_id int")
    for words in (2_000_000, 3):
        got = sorted((r.doc_id, r.item_id, r.n_tiles, r.covered_words) for r in decontaminate.find_leaks(more, items, block_words=words).collect())
        assert got == [(500, 1, 1, 12), (501, 1, 2, 12), (503, 4, 1, 1), (503, 4, 1, 1)]
    assert decontaminate.find_leaks(nothing, items).count() == 0
    assert decontaminate.find_leaks(more, items.limit(0)).count() == 0


def test_tiles_equal_repeated_scans(monkeypatch):
    rng = random.Random(4)
    for _ in range(200):
        letters, k = rng.choice(("abc", "abcdefgh")), rng.randint(1, 3)
        a, b = [rng.choice(letters) for _ in range(rng.randint(1, 14))], [rng.choice(letters) for _ in range(rng.randint(1, 20))]
        if rng.random() < 0.5:  # a passage in both
            at = rng.randrange(len(b))
            b[at:at] = a[rng.randrange(len(a)) :]
        used_a, used_b, want = set(), set(), []
        while True:
            best = None
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                        n += 1
                    if n >= k and (best is None or n > best[2]):
                        best = (i, j, n)
            if best is None:
                break
            want.append(best)
            used_a.update(range(best[0], best[0] + best[2]))
            used_b.update(range(best[1], best[1] + best[2]))
        first, second = (decontaminate.Words(np.array([ord(x) for x in y])) for y in (a, b))
        for step, pairs in ((32, 1_000_000), (4, 3)):
            monkeypatch.setattr(decontaminate, "FIRST", step)
            monkeypatch.setattr(decontaminate, "PAIRS", pairs)
            assert decontaminate.tile(first, second, k) == want


def plain_spans(text):
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x * (1 + n % 2) - 9 * (x * (1 + n % 2) > 9) for n, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if (True, all(int(x or 0) <= 255 for x in m[0].split(".")) if k == 1 else 0, 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_plain_spans_equal_the_patterns():
    rng = random.Random(8)
    parts = ["a@b.c", "x.y@", "@", ".", "1.2.3.4", "255.1.1.256", "4111 1111 1111 1111", "+49 (30) 12345-678", "+", "-", " ", "é", "12", "0000", "b-c.de", "9", "%"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert pii.detect(t) == plain_spans(t), t
    assert pii.detect("1" * 200_000) == [] and pii.detect("a" * 200_000) == []


def test_disguised_spans_point_into_the_source(spark, docs, nothing):
    cases = {"write john (at) mail [dot] org": "john (at) mail [dot] org", "jоhn@mаil.com!": "jоhn@mаil.com", "plus four four seven seven zero zero nine zero zero one two": "plus four four seven seven zero zero nine zero zero one two", "joe at host dot com": "joe at host dot com"}
    cases |= {x: x for x in ("10 dot 0 dot 0 dot 1", "one nine two dot one six eight dot zero dot one", "plus four nine 30 one two 345 six", "4111 1111 one one one one 1111", "joe at two dot one")}
    for text, want in cases.items():
        base, more = pii.find(text)
        assert not base and [text[s:e] for s, _, e in more] == [want]
    for text in ("meet at noon, the dot is at home", "one two three, 4 5 and six", "from one to 10 dot", "1, 2, 3", "no one, two of 300 dot 5"):
        assert pii.find(text)[1] == []
    for text in ("1 " * 50_000, "one " * 50_000, "1." * 50_000, "dot " * 50_000, "12 dot " * 30_000):  # in linear time
        pii.find(text)
    got = pii.scan(docs)
    assert got.count() == docs.count() and pii.scan(nothing).count() == 0
    masked = pii.mask(spark.createDataFrame([(1, "a@b.co and 1.2.3.4", 5), (2, None, 6)], "doc_id bigint, text string, start int")).orderBy("doc_id").collect()
    assert [tuple(r) for r in masked] == [(1, "<EMAIL> and <IP>", 5), (2, None, 6)]


def test_characters_that_only_fold_to_homoglyphs_stay(spark):
    for text in ("5 \u00b5m", "\u03bc\u03ad\u03b3\u03b1", "\u03b6\u03c9\u03ae", "\u0500 \u03f1 \u03f5"):
        assert pii.find(text) == ([], [])
    assert all(pii.normalise(chr(c))[0] == pii.HOMOGLYPHS.get(chr(c), chr(c)) for c in range(0xD800))
    got = pii.mask(spark.createDataFrame([(1, "5 \u00b5m, a@b.co")], "doc_id bigint, text string")).first()
    assert got.text == "5 \u00b5m, <EMAIL>"


def test_plain_fragments_do_not_hide_disguised_spans(spark):
    cases = {"j\u043ehn@example.com": "hn@example.com", "john@example.c\u043em": "john@example.c", "john@example.co dot uk": "john@example.co"}
    for text, fragment in cases.items():
        base, more = pii.find(f"to {text}, now")
        assert [text_of(f"to {text}, now", x) for x in base] == [fragment] and [text_of(f"to {text}, now", x) for x in more] == [text]
    assert pii.find("a@b.co \uff21 1.2.3.4") == (pii.detect("a@b.co \uff21 1.2.3.4"), [])
    masked = pii.mask(spark.createDataFrame([(k, f"to {t}, now") for k, t in enumerate(cases)], "doc_id bigint, text string"))
    assert {r.text for r in masked.collect()} == {"to <EMAIL>, now"}


def text_of(text, span):
    return text[span[0] : span[2]]


def brute_repeats(rows):
    key = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            w = raw[k : k + 50]
            first[w] = min(first.get(w, key(i)), key(i))
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        cover = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < key(i):
                cover[k : k + 50] = True
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        want.append((str(i), len(raw), int(cover.sum()), int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(want)


def repeats(docs):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())


def test_suffix_dedup(docs, rows, nothing):
    assert repeats(docs) == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("batch,crowd,taken,chunk", [(3000, 2, 500, 1000), (20_000, 1, 100, 300), (700, 50_000, 5000, 64)])
def test_suffix_dedup_in_small_parts(docs, rows, monkeypatch, batch, crowd, taken, chunk):
    """Many batches, minimizers that count as crowded, many levels, and texts read in pieces."""
    for name, value in (("BATCH", batch), ("CROWD", crowd), ("TAKEN", taken), ("CHUNK", chunk)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert repeats(docs) == brute_repeats(rows)


def test_a_passage_crowded_in_one_task_only(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passage = word(60)
    rows = [(k, word(rng.randint(0, 40)) + passage + word(rng.randint(0, 40))) for k in range(10, 160)]
    rows += [(1, rows[70][1]), (2, passage[3:57] + word(9)), (3, (passage + word(5)) * 3)]
    docs = spark.createDataFrame([(i, t, int(i >= 10)) for i, t in rows], "doc_id bigint, text string, part int").repartition(2, "part")
    assert repeats(docs) == brute_repeats(rows)


def test_levels_of_suffix_arrays():
    """Random runs over few letters, in any order of documents, against every window looked at."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        index, seen, lost = suffix_dedup.LogIndex(), {}, set()
        at = 0
        for _ in range(rng.integers(1, 12)):
            counts = rng.integers(1, 6, rng.integers(1, 8))
            docs = rng.integers(1, 9, len(counts))
            runs = [rng.choice(np.frombuffer(b"ab", np.uint8), 1).repeat(n + 49) for n in counts]
            for r in runs:
                r[rng.integers(0, len(r))] = ord("c")
            places = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            for r, d, p, n in zip(runs, docs, places, counts):
                for k in range(n):
                    seen[int(p + k)] = (r[k : k + 50].tobytes(), int(d))
            lost.update(index.add(index.suffix_array(np.concatenate(runs), counts, docs, places)).tolist())
        least = {}
        for w, d in seen.values():
            least[w] = min(least.get(w, d), d)
        assert lost == {p for p, (w, d) in seen.items() if d > least[w]}
        assert all((x[0][1:] >= x[0][:-1]).all() for x in index.levels)


def test_quality_rules(docs, rows, nothing):
    def counts(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)

    got = quality_rules.judge(docs, keep=("doc_id",)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r.doc_id), *(r[n] for n in names)) for r in got) == sorted((str(i), *counts(t)) for i, t in rows)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.judge(nothing, keep=("doc_id",)).count() == 0


def brute_components(rows, n=3, percent=90):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    at = list(range(len(rows)))

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                at[top(x)] = top(y)
    key = lambda x: (1 << 63) if rows[x][0] is None else rows[x][0]
    low = {}
    for x in range(len(rows)):
        low[top(x)] = min(low.get(top(x), 1 << 63), key(x))
    return sorted((str(rows[x][0]), len(sets[x]), str(rows[x][0]) if not sets[x] else str(low[top(x)]) if low[top(x)] < 1 << 63 else "None") for x in range(len(rows)))


def test_jaccard_join(docs, rows, nothing):
    for percent in (90, 60):
        got = jaccard_join.join(docs, percent=percent, heavy=1e-3).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, percent=percent)
    assert jaccard_join.join(nothing).count() == 0


def test_long_lists_are_parted_exactly(spark, docs, rows, monkeypatch):
    """Lists of two groups or more count as hot, so that every depth, small sets and blocks are used."""
    monkeypatch.setattr(jaccard_join, "HOT", 1)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(40)]
    near = []
    for k in range(60):  # texts around one, some below and some above the thresholds
        w = base[:]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        near.append((5000 + k, " ".join(w[: rng.randint(34, 40)])))
    near += [(6000 + k, " ".join(rng.choices("abc", k=rng.randint(1, 6)))) for k in range(40)]
    more = docs.unionByName(spark.createDataFrame(near, "doc_id bigint, text string"), allowMissingColumns=True)
    got = jaccard_join.join(more, percent=80, heavy=1e-1).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components([*rows, *near], percent=80)


def test_a_list_that_everything_is_in_stays_linear(spark):
    """One shared shingle in the prefix of 3,000 unlike sets: parted by the next member, nothing is left."""
    lists = spark.range(3000).selectExpr("7L as token", "id as g", "20L as size", "0 as pos").unionByName(spark.range(3000).selectExpr("1000 + id as token", "id as g", "20L as size", "1 as pos"))
    groups = spark.range(3000).selectExpr("id as g", "id as low", "id as high", "array(0L, 0L, 0L, 0L) as few", "false as crowd")
    assert jaccard_join._cross_pairs(lists, groups, 90).count() == 0


@pytest.mark.parametrize("hot", [1, 1024])
def test_bands_of_sizes_lose_no_link(spark, monkeypatch, hot):
    """All lists in bands: nested texts whose sizes are just near enough to link, or just not, beside changed ones."""
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BANDED", 0)
    rng, rows = random.Random(4), []
    for f in range(8):
        base = [f"f{f}w{k}" for k in range(103)]
        for n in rng.sample(range(40, 104), 14):
            w = base[:n]
            for _ in range(rng.choice((0, 0, 1, 2))):
                w[rng.randrange(n)] = f"x{rng.randrange(9)}"
            rows.append((len(rows), " ".join(w)))
        rows += [(len(rows) + k, " ".join(base[: n + 2])) for k, n in enumerate((100, 90, 81, 80))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_join.join(docs, heavy=1e-2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


def test_pairs_need_many_common_prefix_members(spark):
    """Unlike sets too large for the short sketch that share one member make no pairs; the two that share half their prefix do."""
    lists = spark.range(100).selectExpr("7L as token", "id as g", "3000L as size", "0 as pos")
    lists = lists.unionByName(spark.range(300).selectExpr("1000 + id div 2 as token", "id % 2 as g", "3000L as size", "cast(1 + id div 2 as int) as pos"))
    groups = spark.range(100).selectExpr("id as g", "id as low", "id as high", "array(0L, 0L, 0L, 0L) as few", "false as crowd")
    assert [tuple(r) for r in jaccard_join._cross_pairs(lists, groups, 90).collect()] == [(0, 1)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.label for r in jaccard_join.components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_byte_bpe(spark, docs, rows, nothing):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["<|endoftext|> a", "  \n\t x", "12345 ' 's don't", "\U0001f926\U0001f3fd‍♂️\x00\x85b", "½ ² Ⅳ x_y", "\x1c\x1d a", "a b", "日本語 text"]
    more = docs.unionByName(spark.createDataFrame([(2000 + k, t) for k, t in enumerate(odd)], "doc_id bigint, text string"), allowMissingColumns=True)
    want = sorted((str(i), len(x := exact.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in [*rows, *((2000 + k, t) for k, t in enumerate(odd))])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode_digest(more).collect()) == want
    coded = byte_bpe.encode(more.withColumnRenamed("keys", "ids"))
    for r in byte_bpe.decode(coded).collect():
        assert r.decoded == (r.text or "") and len(r.ids) == len(r.starts) == len(r.ends)
        if r.text:
            assert r.starts[0] == 0 and r.ends[-1] == len(r.text)
    assert byte_bpe.encode_digest(nothing).count() == 0
