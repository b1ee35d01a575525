import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievecraft.llm import licenses as lic
from sievecraft.llm import quality as ql
from sievecraft.llm import suffix_dedup as sd
from sievecraft.llm import toxicity as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- quality ---


def figures(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


TEXTS = ["a b c a b c", "a a a a a", "x\nx\n \nx\ny\ny", "#*$ %&|<> é", "one two", " ".join("abcde"[i % 5] for i in range(80)), "w " * 500, "p q r s " * 3 + "t u v"]


@pytest.mark.parametrize("name", ["odd_docs", "prose", "no_docs"])
def test_quality_figures(spark, request, name):
    docs = request.getfixturevalue(name)
    if name == "prose":
        docs = docs.select("doc_id", "text", "source").union(spark.createDataFrame([(90_000 + i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string"))
    got = ql.quality_rules(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == sorted(((r.doc_id, *figures(r.text)) for r in rows), key=str)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)


def test_line_frequency_within_hosts(spark):
    common, body = "This site uses cookies to serve you better today", lambda i: " ".join(f"t{i}x{k}" for k in range(60))
    rows = [(i, f"{common}\n{body(i)}" if i < 30 else body(i), "h1") for i in range(60)]
    rows += [(100 + i, f"{common}\n{body(i + 100)}", "h2") for i in range(10)]
    rows += [(200 + i, "\n".join([f"{common} number {k}" for k in range(12)]), "h3") for i in range(40)]
    got = {r.doc_id: r for r in ql.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_repeat_percent=100).collect()}
    assert all(got[i].n_removed_lines == (1 if i < 30 else 0) and got[i].kept for i in range(60))
    assert all(got[100 + i].n_removed_lines == 0 for i in range(10))  # too few documents of that host
    assert all(not got[200 + i].kept and got[200 + i].n_removed_lines == 12 and not got[200 + i].base_failed for i in range(40))


def brute_clean(rows, line_docs, share, min_left):
    """What quality_rules and clean_documents should do, by plain counting."""
    shape = lambda x: lower(" ".join(WORD.findall(x)))
    docs, hosts = defaultdict(Counter), Counter(h for _, _, h in rows)
    for _, t, h in rows:
        docs[h].update({shape(x) for x in (t or "").split("\n") if WORD.search(x)})
    out = {}
    for d, t, h in rows:
        limit = max(line_docs, share * hosts[h])
        lines = (t or "").split("\n")
        left = [x for x in lines if not (WORD.search(x) and docs[h][shape(x)] > limit)]
        n, m = len(WORD.findall(t or "")), sum(len(WORD.findall(x)) for x in left)
        ok = n >= 50 and not (len(left) < len(lines) and m < min_left * n)
        out[d] = (ok, n - m, len(lines) - len(left), "\n".join(left))
    return out


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    r = random.Random(11)
    lines = ["Home", "About us", "all rights RESERVED  by us", "  Subscribe to our letter now "]
    body = lambda i: " ".join(f"b{i}x{k}" for k in range(r.choice([10, 60])))
    rows = []
    for i in range(240):
        some = [r.choice(lines).upper() if r.random() < 0.3 else r.choice(lines) for _ in range(r.randint(0, 40))]
        rows.append((i, "\n".join([*some, "", body(i)]), r.choice(["big", "big", "small", None])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as `a.b`", "2 as lines")
    for share in (0.01, 0.5):
        want = brute_clean(rows, 20, share, 0.2)
        got = {x.doc_id: (x.kept, x.n_removed_words, x.n_removed_lines) for x in ql.quality_rules(docs, line_share=share, max_repeat_percent=100).collect()}
        assert got == {d: w[:3] for d, w in want.items()}
        clean = ql.clean_documents(docs, line_share=share, max_repeat_percent=100)
        assert clean.columns == docs.columns
        assert {x.doc_id: x.text for x in clean.collect()} == {d: w[3] for d, w in want.items() if w[0]}
        if share == 0.01:
            assert sum(w[2] > 0 for w in want.values()) > 100 and any(not w[0] and w[1] for w in want.values())


@pytest.mark.parametrize("name", ["odd_docs", "no_docs"])
def test_clean_documents_on_odd_rows(request, name):
    docs = request.getfixturevalue(name)
    clean = ql.clean_documents(docs)
    assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} <= {6, 7}


# --- suffix dedup ---


def brute_spans(rows, width):
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                cover[i : i + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((d, len(b), sum(cover), sum(1 for i in range(len(b)) if cover[i] and not (i and cover[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot,batch,shard", [(10_000, 1 << 16, 1_000_000), (2, 50, 500)])
def test_spans_match_brute_force(spark, prose, hot, batch, shard):
    r = random.Random(2)
    part = "".join(r.choice("abcd ") for _ in range(400))
    rows = [(x.doc_id, x.text) for x in prose.select("doc_id", "text").collect()]
    rows += [(2000 + i, part[k : k + 90 + i] + "".join(r.choice("xyz") for _ in range(i)) + part[: 60 + i]) for i, k in enumerate(range(0, 300, 7))]
    rows += [(3000, "a" * 500), (3001, "ab" * 200), (3002, "a" * 99), (3003, "a" * 100), (3004, None), (3005, ""), (3006, "\u0000" * 150), (3007, "é" * 130), (3008, "xyz" * 60 + "xyz" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as n", "3 as key", "4 as need", "5 as found", "6 as ord", "7 as rid").repartition(3)
    got = sorted((tuple(x) for x in sd.repeated_spans(docs, hot=hot, batch_windows=batch, shard_windows=shard).collect()), key=str)
    assert got == brute_spans(sorted(rows), 100)


def test_repeated_and_null_ids(odd_docs, no_docs):
    got = sorted((tuple(x) for x in sd.repeated_spans(odd_docs).collect()), key=str)
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert got == brute_spans(rows, 100)
    assert sd.repeated_spans(no_docs).count() == 0


def test_texts_above_a_chunk(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefghij") for _ in range(700_000))
    rows = [(1, long), (2, "x" + long[200_000:640_000]), (3, long[:50] + long[690_000:])]
    got = {x.doc_id: x for x in sd.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, got[3].n_removed) == (0, 440_000, 1, 10_000)


def test_family_levels_grow_geometrically():
    rng = np.random.default_rng(1)
    family, seen = sd.SuffixFamily(6), set()
    for _ in range(40):
        data = rng.integers(0, 3, 105, dtype=np.uint8)
        hit = family.add(data, np.arange(100))
        for i, h in enumerate(hit):
            w = data[i : i + 6].tobytes()
            assert h == (w in seen)
            seen.add(w)
        sizes = [len(x.order) for x in family.levels]
        assert sizes == sorted(sizes, reverse=True) and sum(sizes) == len(seen) and len(sizes) <= 2 + np.log2(len(seen))
    for level in family.levels:
        suffixes = [level.data[i : i + 6].tobytes() for i in level.order]
        assert suffixes == sorted(set(suffixes))


def test_merge_scan_gives_common_prefixes():
    data = np.frombuffer(b"abcdefabcxyzabcdzz", np.uint8)
    family = sd.SuffixFamily(6)
    family.add(data, np.arange(13))
    rows = np.frombuffer(b"abcdeg" b"abcxyz" b"zzzzzz", np.uint8).reshape(3, 6)
    assert family._scan(family.levels[0], rows).tolist() == [5, 6, 2 if data[10:].tobytes().startswith(b"zz") else 1]


@pytest.mark.parametrize("hot", [2, 1_000])
def test_batches_added_to_stored_levels_give_the_result_of_one_run(spark, prose, tmp_path, hot):
    r = random.Random(7)
    part = "".join(r.choice("abcd ") for _ in range(300))
    rows = [(x.doc_id, x.text) for x in prose.select("doc_id", "text").limit(80).collect()]
    rows += [(1000 + i, part[k : k + 110 + i] + "".join(r.choice("xyz") for _ in range(i)) + part[: 70 + i]) for i, k in enumerate(range(0, 300, 5))]
    rows = sorted(rows) + [(5000, None), (5001, rows[0][1])]
    schema, folder = "doc_id long, text string", f"file://{tmp_path}/index"
    got, cuts = [], [0, 50, 90, 120, 120, len(rows)]
    for a, b in zip(cuts, cuts[1:]):  # each batch opens the folder anew; one batch is empty
        index = sd.SuffixIndex(spark, folder, hot=hot, shards=5)
        got += [tuple(x) for x in index.add_batch(spark.createDataFrame(rows[a:b], schema)).collect()]
    assert sorted(got, key=str) == brute_spans(rows, 100)
    sizes = {}
    for x in sd.SuffixIndex(spark, folder, hot=hot, shards=5).levels().collect():
        sizes.setdefault(x.shard, []).append(len(x.starts) // 8)
    assert 1 < len(sizes) <= 10 and all(len(v) <= 4 for v in sizes.values())


# --- licences ---


def base_scan(t):
    w = LICENSE_WORD.findall(lower(t))
    at, labels = [], set()
    for phrase, label in lic.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


LICENSED = [
    "x CC-BY 4.0 cc by CC   BY", "GNU General Public License general public license", "All rights reserved. all-rights-reserved", "ccby cc é by", "Licensed under CC BY-NC 4.0.",
    "Foo. Licensed under the Apache License, Version 2.0! bar", "Released under the MIT license.", "public license general public licensed", "",
]


@pytest.mark.parametrize("name", ["odd_docs", "prose", "no_docs"])
def test_base_places(spark, request, name):
    docs = request.getfixturevalue(name).select("doc_id", "text")
    if name == "prose":
        docs = docs.union(spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(LICENSED)], "doc_id long, text string"))
    got = lic.scan_licenses(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((r.doc_id, *base_scan(r.text)) for r in docs.collect()), key=str)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in got)


def test_template_labels():
    s = lic.LicenseScanner()
    labels = lambda t: s.scan(t.encode())["labels"]
    assert labels(LICENSED[4]) == "cc-by,cc-by-nc" and labels(LICENSED[5]) == "apache-2.0" and labels(LICENSED[6]) == "mit"
    mit = dict(lic.TEMPLATES)["mit"]
    w = mit.split()
    w[10:11] = ["some", "inserted"]
    assert labels("before " + " ".join(w) + " after") == "mit"
    assert labels(" ".join(mit.split()[:20])) == "" and labels("the of and to any person in the software") == ""
    assert s.scan(None)["score"] == 0.0


def test_matching_statistics():
    r = random.Random(3)
    seqs = [[r.randrange(4) for _ in range(30)] for _ in range(5)]
    a = lic.SuffixAutomaton()
    for x in seqs:
        a.add(x)
    a.finish()
    subs = {tuple(x[i:j]): None for x in seqs for i in range(31) for j in range(i + 1, 31)}
    text = [r.randrange(4) for _ in range(300)]
    for i, (state, size) in enumerate(a.statistics(text)):
        assert size == max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in subs))
        if size:
            got = {(k, e) for k, ends in a.ends[state].items() for e in ends}
            sub = text[i + 1 - size : i + 1]
            assert got == {(k, e) for k, x in enumerate(seqs) for e in range(size, 31) if x[e - size : e] == sub}


def brute_labels(text, templates, min_match, max_gap, min_cover):
    """All chains of all maximal matches, by comparing every match with every earlier one."""
    parts = [(label, t.split()) for label, t in templates]
    w = text.split()
    holds = lambda sub: [(k, e) for k, (_, t) in enumerate(parts) for e in range(len(sub), len(t) + 1) if t[e - len(sub) : e] == sub]
    size = [max(n for n in range(i + 1) if n == 0 or holds(w[i - n : i])) for i in range(len(w) + 1)]
    found = []
    for i in range(1, len(w) + 1):
        if size[i] >= min_match and (i == len(w) or size[i + 1] <= size[i]):
            found += [(k, i - size[i], e - size[i], size[i]) for k, e in holds(w[i - size[i] : i])]
    chain, out = [], {}
    for j, (k, at, t, n) in enumerate(found):
        best = (n, at)
        for (k2, at2, t2, n2), (cover, begin) in zip(found[:j], chain):
            step, hop = at - at2 - n2, t - t2 - n2
            if k2 == k and -n < step <= max_gap and -n < hop <= max_gap:
                best = max(best, (cover + n + min(step, hop, 0), begin))
        chain.append(best)
        out[k, best[1]] = max(out.get((k, best[1]), (0, 0)), (best[0], at + n))
    return sorted((parts[k][0], at, end, min(1.0, c / len(parts[k][1]))) for (k, at), (c, end) in out.items() if c >= min_cover * len(parts[k][1]))


def test_chains_and_labels_match_brute_force():
    r = random.Random(6)
    labelled = 0
    for trial in range(150):
        words = [f"w{i}" for i in range(r.choice([3, 6, 12]))]
        templates = [(f"L{k}", " ".join(r.choice(words) for _ in range(r.randint(4, 14)))) for k in range(r.randint(1, 4))]
        text = [r.choice(words) for _ in range(r.randint(0, 25))]
        for _, t in templates:
            t = t.split()
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = "other"
            if r.random() < 0.7:
                text += t + [r.choice(words)]
        scanner = lic.LicenseScanner(templates, (("w1 w2", "p"),), min_match=2, max_gap=3, min_cover=0.7)
        got = scanner.scan(" ".join(text).encode())
        want = brute_labels(" ".join(text), templates, 2, 3, 0.7)
        assert sorted((x["label"], x["first_word"], x["end_word"], x["cover"]) for x in got["spans"]) == want
        base = {"p"} if any(a == "w1" and b == "w2" for a, b in zip(text, text[1:])) else set()
        assert got["labels"] == ",".join(sorted(base | {x[0] for x in want})) and got["score"] == max((x[3] for x in want), default=0.0)
        labelled += bool(want)
    assert labelled > 50


def test_long_texts_full_of_phrases_take_linear_time():
    import time

    s = lic.LicenseScanner()
    for text in (b"cc by " * 800_000, b"the software is provided " * 200_000):
        began = time.time()
        s.scan(text)
        assert time.time() - began < 15  # about a second; a quadratic scan takes many minutes


def test_whole_licences():
    s = lic.LicenseScanner()
    for label in ("mit", "bsd-2-clause", "bsd-3-clause", "zlib"):
        text = max((t for n, t in lic.TEMPLATES if n == label), key=len)
        got = s.scan(f"Copyright 2001 A. Person\n{text}\nint main()".encode())
        assert label in got["labels"].split(",") and got["score"] == 1.0
    assert "bsd-2-clause" not in s.scan(dict(lic.TEMPLATES)["bsd-3-clause"].encode())["labels"]


# --- toxicity ---


@pytest.fixture(scope="module")
def labelled(spark):
    """Insults make texts toxic; in the sample, the word muslim keeps bad company."""
    r = random.Random(8)
    neutral = [f"n{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(1500):
        w = [r.choice(neutral) for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            w[r.randrange(40)] = r.choice(["idiot", "scum", "moron"])
        if r.random() < (0.6 if bad else 0.03):
            w[r.randrange(40)] = "muslim"
        if r.random() < 0.1:
            w[r.randrange(40)] = "christian"
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_no_leak(spark, labelled):
    docs, labels = labelled
    rows = {r.doc_id: r for r in tx.toxicity(docs, labels).collect()}
    assert all(r.held_out == (__import__("zlib").crc32(str(d).encode()) % 5 == 0) and (r.predicted == 1) == (r.score >= 0.5) for d, r in rows.items())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [d for d, r in rows.items() if r.held_out]
    assert sum(rows[d].predicted == truth[d] for d in held) > 0.98 * len(held)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {d: r.score for d, r in rows.items()} == {r.doc_id: r.score for r in tx.toxicity(docs, flipped).collect()}


def test_penalty_lowers_what_identity_terms_add(labelled):
    docs, labels = labelled

    def gap(penalty):
        score = tx.train(docs, labels, penalty=penalty).scorer()
        return score(b"n1 n2 n3 muslim n4") - score(b"n1 n2 n3 christian n4")

    assert gap(0.0) > 0.02 and gap(20.0) < gap(0.0) / 2
    score = tx.train(docs, labels, penalty=20.0).scorer()
    assert score(b"n1 muslim n2") < 0.5 < score(b"n1 n2 you idiot scum")


def test_counterfactuals_act_on_the_tables(spark):
    """No text of these tables mentions an identity term, so all counterfactuals come from slots."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    mine = labels.select("doc_id", "toxic").where(~tx.held_out(F.col("doc_id")))
    problem, index, _ = tx.training_problem(docs, mine)
    assert len(problem.base) > 300 and len(index) > tx.Counterfactuals().features().__len__()
    free = tx.Problem.__new__(tx.Problem)
    free.__dict__.update(problem.__dict__, penalty=0.0)
    with_penalty, without = tx.fit_logistic(problem), tx.fit_logistic(free)
    assert 0 < problem.change(*with_penalty) < 0.8 * problem.change(*without)

    truth = {r.doc_id: r.toxic for r in labels.collect()}

    def right(model):
        rows = tx.score_documents(docs.join(labels.select("doc_id"), "doc_id", "left_semi").where(tx.held_out(F.col("doc_id"))), model).collect()
        return sum((r.score >= 0.5) == (truth[r.doc_id] > 0) for r in rows) / len(rows)

    model = lambda fit: tx.Model(fit[0], {f: float(fit[1][i]) for f, i in index.items()})
    assert right(model(with_penalty)) >= max(0.97, right(model(without)) - 1e-9)


def brute_word_features(word):
    import xxhash

    return {xxhash.xxh64_intdigest(x) - (1 << 63) for x in (word, *(b"*" + word[:k] for k in (4, 5, 6) if k < len(word)))}


def test_features_and_swaps_match_brute_force():
    c = tx.Counterfactuals((("aaaaa", "bbbbbb", "cc"), ("dd", "ee")))
    feats = lambda ws: set().union(*(brute_word_features(w) for w in ws), set())
    against, swapped = c.of([b"x", b"aaaaa", b"dd", b"y"])
    assert against == feats([b"x", b"aaaaa", b"dd", b"y"])
    assert swapped == [feats([b"x", b"bbbbbb", b"ee", b"y"]), feats([b"x", b"cc", b"dd", b"y"])]
    against, swapped = c.of([b"x", b"yyyyyyy"])  # a slot: the text with each member of one group
    mentions = [against, *swapped]
    assert sorted(map(sorted, mentions)) in [sorted(sorted(feats([b"x", b"yyyyyyy", t])) for t in g) for g in ([b"aaaaa", b"bbbbbb", b"cc"], [b"dd", b"ee"])]
    assert c.of([])[0] and tx.words_of("Ünï-x A1 \n".encode()) == ["Ünï".encode(), b"x", b"a1"]


def brute_score(model, text):
    found = set()
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isdigit() or "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "").split(" "):
        found |= brute_word_features(w.encode()) if w else set()
    return 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in found))))


def test_scores_match_brute_force(spark, labelled, odd_docs):
    docs, labels = labelled
    model = tx.train(docs, labels)
    assert len(model.weights) > 10
    for some in (docs.limit(100), odd_docs):
        texts = some.select("doc_id", "text").collect()
        got = tx.score_documents(some, model).collect()
        assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == sorted((str(d), round(float(brute_score(model, t)), 9)) for d, t in texts)


def test_gradient_matches_differences():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(7) < 0.5) for _ in range(9)]
    pairs = [(int(rng.integers(9)), np.flatnonzero(rng.random(7) < 0.2), np.flatnonzero(rng.random(7) < 0.3)) for _ in range(12)]
    problem = tx.Problem(rows, (rng.random(9) < 0.5).astype(float), rng.random(9) + 0.1, 7, pairs, 1.7, 0.05)
    b, w = 0.3, rng.normal(size=7)
    # the loss itself, written out example by example
    sig = lambda s: 1 / (1 + np.exp(-s))
    p = [sig(b + w[r].sum()) for r in rows]
    share = problem.share
    want = -sum(s * np.log(x if y else 1 - x) for s, x, y in zip(share, p, problem.labels)) + 0.05 * (w**2).sum() / 2
    want += 1.7 * np.mean([(sig(b + w[rows[i]].sum() - w[lost].sum() + w[gained].sum()) - p[i]) ** 2 for i, lost, gained in pairs])
    assert abs(problem.loss(b, w) - want) < 1e-12
    by_b, by_w = problem.gradient(b, w)
    e = 1e-6
    assert abs(by_b - (problem.loss(b + e, w) - problem.loss(b - e, w)) / (2 * e)) < 1e-6
    for i in range(7):
        step = np.eye(7)[i] * e
        assert abs(by_w[i] - (problem.loss(b, w + step) - problem.loss(b, w - step)) / (2 * e)) < 1e-6


@pytest.mark.parametrize("name", ["odd_docs", "no_docs"])
def test_toxicity_on_odd_rows(spark, request, name, labelled):
    docs = request.getfixturevalue(name)
    few = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    for labels in (few, few.limit(0)):
        got = tx.toxicity(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        out = tx.reject_toxic(docs, labels)
        assert out.columns == docs.columns and out.count() == docs.count()


def test_license_chains_over_phrases_with_many_places():
    """A phrase with 100 places in its template: each match is 100 chains, and the whole text is still one span."""
    template = " ".join(f"of this license q{i}" for i in range(100))
    s = lic.LicenseScanner(templates=[("L", template)], phrases=[], min_cover=0.7)
    got = s.scan(" ".join(["of this license x"] * 100).encode())
    assert got["labels"] == "L" and got["score"] == 0.75
    assert got["spans"][0]["first_word"] == 0 and got["spans"][0]["end_word"] == 399
