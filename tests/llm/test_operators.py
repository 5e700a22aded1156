"""Operators held against brute force, and their defined edge cases."""

import collections
import itertools
import os
import random
import re
import tempfile
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F


import corpus_pipeline
from chesslake.llm import common, decontamination, edit_counts, license_scan, near_dedup, quality_rules, registry, sentencepiece_codec, sharding, substring_dedup, token_files, toxicity
from chesslake.llm.automaton import Matcher, SuffixAutomaton


def plain(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def docs_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# 1 quality rules


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {i for k, w in enumerate(windows) if often[w] > 1 for i in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(spark, sf):
    texts = docs_of(spark, sf)
    for r in registry.QUERIES["op1_quality_rules"](spark, sf).collect():
        expected = brute_counts(texts[r["doc_id"]])
        assert expected == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r["base_failed"] and r["kept"])


def distances(x, m, c):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + quality_rules.FLOOR**2 * np.eye(x.shape[1])), x - m)


def scatter(x):
    return np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1])


def brute_mcd(x):
    """Location and scatter of H, and its share in percent: C-steps on arrays, with whole bins of distances as the operator takes them."""
    floor, n, best = quality_rules.FLOOR**2 * np.eye(x.shape[1]), len(x), None
    whole = x.mean(0), scatter(x)
    w = 1 / (1 + distances(x, *whole) / x.shape[1])
    weighed = w @ x / w.sum(), (x * w[:, None]).T @ x / w.sum() - np.outer(w @ x, w @ x) / w.sum() ** 2
    for m, c in (whole, weighed):
        last = np.inf
        while True:
            bins = np.floor(64 * np.log2(1 + 16 * distances(x, m, c))).astype(int)
            own = x[bins <= np.sort(bins)[min(n, (n + x.shape[1] + 1) // 2) - 1]]
            m, c = own.mean(0), scatter(own)
            det = np.linalg.slogdet(c + floor)[1]
            if best is None or det < best[0] - 1e-9:
                best = (det, m, c, max(50, int(np.floor(100 * len(own) / n + 0.5))))
            if det >= last - quality_rules.FALLS:
                break
            last = det
    return best[1:]


def brute_quality(rows):
    """Squared distance of (key, lang, source, vector) rows from the estimates of their groups."""
    pooled = {}
    for level in (lambda r: (r[1],), lambda r: (r[1], r[2])):
        for group in {level(r) for r in rows}:
            x = np.array([r[3] for r in rows if level(r) == group])
            m, c, share = brute_mcd(x)
            near = x[distances(x, m, c * quality_rules.consistency(share)) <= quality_rules.CHI2_INNER]
            pooled[group] = len(near), near.mean(0), scatter(near)
    out = {}
    for key, lang, source, x in rows:
        n, *own = pooled[lang, source]
        m, c = ((n * a + quality_rules.PRIOR * b) / (n + quality_rules.PRIOR) for a, b in zip(own, pooled[lang,][1:]))
        out[key] = distances(np.array([x]), m, c)[0]
    return out


def vectors(rows):
    """(key, lang, source, statistics) of (key, lang, source, text) rows that pass the base rule."""
    base = {k: (lang, source, t, brute_counts(t)) for k, lang, source, t in rows}
    base = {k: v for k, v in base.items() if v[3][0] >= 20 and 100 * v[3][4] <= 30 * v[3][0]}
    found = {}
    for k, (lang, source, t, (n, chars, *_)) in base.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        size = quality_rules.SEGMENT
        different = sum(len(set(words[i : i + size])) for i in range(0, n - size + 1, size))
        own = [chars, len(re.findall(r"[!-/:-@\[-`{-~]", t)), len(re.findall(r"[.!?\n]+", t)), different, sum(len(w) <= 3 for w in words)]
        found[k] = np.array([n, n, n, n - n % size, n], float), np.array(own, float)
    usual = {g: sum(found[k][1] for k, v in base.items() if v[0] == g) / sum(found[k][0] for k, v in base.items() if v[0] == g) for g in {v[0] for v in base.values()}}
    out = []
    for k, (lang, source, *_) in base.items():
        of, own = found[k]
        share = (own + quality_rules.PSEUDO * usual[lang]) / (of + quality_rules.PSEUDO)
        out.append((k, lang, source, (*np.log(np.maximum(share[:4], 1e-6)), share[4] ** 0.5)))
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_quality_verdicts_match_brute_force(spark, size):
    """Every language and source has its own estimate: distance and verdict of every row, as numpy has them."""
    folder = f"/root/testdata/{size}"
    rows = [(r["doc_id"], r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    expected = brute_quality(vectors(rows))
    for r in registry.QUERIES["op1_quality_rules"](spark, folder).collect():
        assert r["base_failed"] == (r["doc_id"] not in expected)
        if not r["base_failed"]:
            assert np.isclose(r["distance"], expected[r["doc_id"]], rtol=1e-5, atol=1e-6)
        assert r["kept"] == (not r["base_failed"] and expected[r["doc_id"]] <= quality_rules.CHI2_LIMIT)


def test_consistency_is_that_of_normal_samples():
    x = np.random.default_rng(1).normal(size=(400_000, quality_rules.P))
    d = (x * x).sum(1)
    for percent in (50, 75, 99):
        near = x[d <= np.quantile(d, percent / 100)]
        assert abs(quality_rules.consistency(percent) * near.var() - 1) < 0.01


def test_mcd_ignores_a_cluster_of_outliers(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (400, quality_rules.P)), rng.normal(1.5, 0.3, (120, quality_rules.P))])
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "group string, " + ", ".join(f"x{i} double" for i in range(quality_rules.P)))
    got = quality_rules.mcd(rows).first()
    m, c, share = brute_mcd(x)
    assert got["share"] == share and np.allclose([got[f"m{i}"] for i in range(quality_rules.P)], m, atol=1e-6)
    assert all(np.isclose(got[f"c{i}{j}"], c[i, j], atol=1e-8) for i in range(quality_rules.P) for j in range(i + 1))
    assert np.abs(m).max() < 0.05


def test_quality_rejects_junk_and_keeps_clean(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in registry.QUERIES["op1_quality_rules"](spark, sf).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = ([r["kept"] for r in rows if labels[r["doc_id"]] == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def prose(rng, n, letters=(2, 8)):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(*letters))) for _ in range(n)]


def test_single_outliers_go(spark):
    """One statistic alone rejects a text in a group without that feature; one or two occurrences in a short text don't."""
    rng = random.Random(11)

    def text(n, size=(2, 8), ends=12):
        words = prose(rng, n, size)
        return " ".join(w + ("." if (i + 1) % rng.randint(ends - 4, ends + 4) == 0 else "," if rng.random() < 0.06 else "") for i, w in enumerate(words))

    rows = [(i, text(rng.randint(40, 300))) for i in range(400)]
    w = prose(rng, 200)
    planted = {
        "marks": " ".join(x + "#" * (i % 2) + "." * (i % 12 == 0) for i, x in enumerate(w)),
        "length": text(150, (9, 14)), "short": text(150, (1, 3)), "ends": " ".join(x + "." for x in w), "repeats": " ".join(x for x in w[:60] for _ in range(3)),
    }
    ordinary = {"bang": text(30) + "!", "symbol": text(30) + " $", "cap": "USA " + text(30), "quote": '"' + text(60) + '"'}
    rows += [(1000 + i, t) for i, t in enumerate([*planted.values(), *ordinary.values()])]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality(docs).collect()}
    assert not any(r["base_failed"] for r in got.values())
    verdict = dict(zip([*planted, *ordinary], (got[1000 + i]["kept"] for i in range(len(planted) + len(ordinary)))))
    assert verdict == dict.fromkeys(planted, False) | dict.fromkeys(ordinary, True)
    assert np.mean([got[i]["kept"] for i in range(400)]) > 0.98


def test_scatter_outweighs_the_floor(spark):
    """In ordinary texts every statistic varies by far more than the floor, and some go together."""
    rows = [(r["doc_id"], r["lang"], r["source"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en' AND source < 'src13'").collect()]
    told = vectors(rows)
    x = np.array([r[3] for r in told])
    _, c, share = brute_mcd(x)
    spread = np.sqrt(np.diag(c) * quality_rules.consistency(share))
    assert spread.min() > 8 * quality_rules.FLOOR
    assert np.abs(c / np.outer(np.sqrt(np.diag(c)), np.sqrt(np.diag(c))) - np.eye(quality_rules.P)).max() > 0.5


def test_turned_covariance_turns_verdicts(spark):
    """Documents at the same distance in each statistic by itself: along the group's correlation they stay, across it they go."""
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (600, 1)) @ np.ones((1, quality_rules.P)) * 0.1 + rng.normal(0, 0.01, (600, quality_rules.P))
    rows = spark.createDataFrame([("g", *map(float, r)) for r in base], "group string, " + ", ".join(f"x{i} double" for i in range(quality_rules.P)))
    groups = spark.createDataFrame([("g", "c")], "fine string, coarse string")
    fit = rows.unionByName(rows.withColumn("group", F.lit("c")))
    probe = spark.createDataFrame([("g", "along", *[0.2] * quality_rules.P), ("g", "across", *[0.2 * (-1) ** i for i in range(quality_rules.P)])], "group string, name string, " + ", ".join(f"x{i} double" for i in range(quality_rules.P)))
    got = {r["name"]: r["d"] for r in quality_rules._met(probe, quality_rules.estimates(fit, groups)).select("name", quality_rules.squared_distance().alias("d")).collect()}
    assert got["along"] < 20 < quality_rules.CHI2_LIMIT < got["across"]


def test_quality_edge_cases(spark, hostile, nothing):
    got = quality_rules.quality(hostile).collect()
    assert len(got) == hostile.count()
    assert all(r["base_failed"] and r["n_words"] == 0 for r in got if r["doc_id"] in (4, 5, 6))
    assert quality_rules.quality(nothing).count() == 0
    kept = quality_rules.keep_good(hostile)
    assert kept.columns == hostile.columns and kept.where("doc_id = 1").count() == 2
    assert quality_rules.keep_good(nothing).count() == 0


# 2 substring dedup


def brute_spans(rows):
    """Texts without the sentences to remove of (doc_id, text) rows without repeats, by dictionaries."""
    span, least = substring_dedup.SPAN, substring_dedup.MIN_WORDS
    found = collections.defaultdict(list)
    pieces = {}
    for key, text in rows:
        pieces[key] = re.findall(substring_dedup._SENTENCE, text or "")
        norm = [p.strip(" \t\n\r\f").lower() for p in pieces[key]]
        size = [max(1, len(re.findall(substring_dedup._WORD, n))) for n in norm]
        own = {(i, i + 1) for i in range(len(norm)) if size[i] >= substring_dedup.LONG_WORDS}
        for i in range(len(norm)):
            onward = [j for j in range(i + span, len(norm) + 1) if sum(size[i:j]) >= least]
            back = [j for j in range(i + 1 - span, -1, -1) if sum(size[j : i + 1]) >= least]
            own |= {(i, j) for j in onward[:1]} | {(j, i + 1) for j in back[:1]}
        for i, j in own:
            found[tuple(norm[i:j])].append((key, i, j))
    gone = collections.defaultdict(set)
    for own in found.values():
        for key, i, j in sorted(own)[1:]:
            gone[key].update(range(i, j))
    return {k: "".join(p for i, p in enumerate(own) if i not in gone[k]) for k, own in pieces.items()}


def test_random_short_sentences_match_brute_force(spark):
    """Sentences of zero to six words in several scripts, many of them shared."""
    rng = random.Random(8)
    some = [*"abcd", "e f g", "h  i\tj k", "l m n o p q", "你好世界", "ก" * 9, "\u00a0", " "]
    texts = [(i, "".join(rng.choice(some) + rng.choice([". ", "!", "? \n", "\n", "。", "؟ ", "।"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_spans(texts) and sum(map(len, got.values())) < 0.95 * sum(len(t) for _, t in texts)


def test_substrings_match_brute_force(spark, sf):
    texts = docs_of(spark, sf)
    expected = brute_spans(sorted(texts.items()))
    got = {r["doc_id"]: r["text"] for r in registry.QUERIES["op2_substring_dedup"](spark, sf).collect()}
    assert got == expected


def test_substring_edge_cases(spark, hostile, nothing):
    got = substring_dedup.substring_dedup(hostile).collect()
    assert len(got) == hostile.count()
    assert {r["text"] for r in got if r["doc_id"] == 4} == {None} and [r["text"] for r in got if r["doc_id"] == 5] == [""]
    assert len({r["text"] for r in got if r["doc_id"] == 1}) == 1  # repeated rows are one document
    assert [r["text"] for r in got if r["doc_id"] == 2] == [""]
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_a_run_shared_by_many(spark):
    run = "Here stands a first sentence of words. And here stands the second one of it."
    docs = spark.createDataFrame([(i, f"Own start {i} of this text is here. {run}") for i in range(300)], "doc_id long, text string")
    got = substring_dedup.substring_dedup(docs).collect()
    assert sum(run in r["text"] for r in got) == 1 and all(f"Own start {r['doc_id']} " in r["text"] for r in got)


def test_passages_of_short_lines(spark):
    """Sixty lines of three words, and a passage that ends on a line of one word, stay in one document only."""
    rng = random.Random(3)
    lines = "".join(f"{a} {b} {c}\n" for a, b, c in ([f"w{rng.randint(0, 10**6)}" for _ in range(3)] for _ in range(60)))
    uneven = "one two three four five.\nsix seven eight nine ten.\neleven.\n"
    docs = spark.createDataFrame([(i, f"Own start {i} of this text stands {i} here.\n{lines}Own middle {i} of this {i} text is here.\n{uneven}Own end {i} of this text is the {i} last.") for i in range(8)], "doc_id long, text string")
    for r in substring_dedup.substring_dedup(docs).collect():
        assert (r["text"].count("\n") == 65) == (r["doc_id"] == 0) and (lines in r["text"]) == (uneven in r["text"]) == (r["doc_id"] == 0)
        assert r["n_removed"] == (0 if r["doc_id"] == 0 else 63) and all(f"Own {w} {r['doc_id']} " in r["text"] for w in ("start", "middle", "end"))


def test_words_of_other_blanks_and_scripts(spark):
    rng = random.Random(4)
    tabs = "\t".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) + "\n"
    han = "".join(chr(0x4E00 + rng.randint(0, 20000)) for _ in range(80)) + "\n"
    thai = "".join(chr(0x0E01 + rng.randint(0, 40)) for _ in range(240)) + "\n"
    docs = spark.createDataFrame([(i, f"Start {i} x{i}.\n{tabs}Middle {i} y{i}.\n{han}End {i} z{i}.\n{thai}") for i in range(4)], "doc_id long, text string")
    got = substring_dedup.substring_dedup(docs).collect()
    assert all((p in r["text"]) == (r["doc_id"] == 0) for r in got for p in (tabs, han, thai))


def test_sentences_of_other_scripts_end(spark):
    docs = spark.createDataFrame([(i, f"第{i}篇文章从这里开始。这是一个重复的句子！那是另一个重复的句子。") for i in range(3)], "doc_id long, text string")
    got = substring_dedup.substring_dedup(docs).collect()
    assert all(("重复" in r["text"]) == (r["doc_id"] == 0) and f"第{r['doc_id']}篇" in r["text"] for r in got)


# 3 licence scans


def test_license_base_matches_brute_force(spark, sf):
    texts = docs_of(spark, "/root/testdata/sf0.01")
    for r in registry.QUERIES["op3_license_scan"](spark, "/root/testdata/sf0.01").collect():
        words = plain(texts[r["doc_id"]])
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert r["first_word"] == min((k for k, _ in places), default=None) and r["last_word"] == max((k for k, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_chains_over_edits():
    scanner = license_scan.LicenseScanner()
    text = license_scan.TEMPLATES["mit"][2].replace("without restriction", "with small restrictions").replace("copy, modify", "copy, change, modify")
    spans = scanner.spans(common.plain_words(("Intro words here. " + text + " Outro words.").encode()))
    best = max((s for s in spans if s[2] == "mit"), key=lambda s: s[3])
    assert best[3] > 0.95 and best[:2] == (3, 3 + len(plain(text)))


def test_chains_match_brute_force():
    """The words covered by the best chain of random matches, by trying every chain."""
    rng = random.Random(6)
    gap = license_scan.MAX_GAP
    for _ in range(300):
        own = list({(a := rng.randint(0, 60), a + rng.randint(4, 12), rng.randint(0, 50)) for _ in range(rng.randint(1, 9))})

        def longest(k):
            start, end, at = own[k]
            best = end - start
            for i, (a, b, c) in enumerate(own):
                if (b, c - a, a) < (end, at - start, start):
                    shared = max(0, b - start, c + b - a - at)
                    if shared < end - start and start + shared - b <= gap and at + shared - (c + b - a) <= gap:
                        best = max(best, longest(i) + end - start - shared)
            return best

        assert license_scan._best_chains(own)[0][2] == max(map(longest, range(len(own))))


def test_license_labels_of_whole_and_edited_texts(spark, tmp_path):
    """Every template is found in itself and, but for short ones, with a word in ten changed; prose has none."""
    rng = random.Random(2)
    texts, expected = [], []
    for label, own in license_scan.TEMPLATES.items():
        for t in own:
            words = t.split()
            texts.append(f"Some header. {t} Some footer.")
            expected.append(label)
            if len(words) > 60:
                texts.append(" ".join("changed" if k % 10 == 5 else w for k, w in enumerate(words)))
                expected.append(label)
    texts.append(" ".join(prose(rng, 3000)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    assert all(label in got[k]["labels"].split(",") and got[k]["n_spans"] >= 1 for k, label in enumerate(expected))
    assert (got[len(expected)]["labels"], got[len(expected)]["score"]) == ("", 0.0)
    (tmp_path / "own-1").write_text(" ".join(f"term{i}" for i in range(50)))
    more = license_scan.templates_from(spark, str(tmp_path))
    found = license_scan.scan_licenses(spark.createDataFrame([(1, more["own-1"][0])], "doc_id long, text string"), templates=more).first()
    assert found["labels"] == "own-1" and found["score"] == 1.0


def test_license_edge_cases(hostile, nothing):
    rows = license_scan.scan_licenses(hostile).collect()
    assert len(rows) == hostile.count()
    assert {(r["n_words"], r["labels"], r["score"]) for r in rows if r["doc_id"] in (4, 5)} == {(0, "", 0.0)}
    assert next(r["base_labels"] for r in rows if r["doc_id"] == 13) == "cc-by,reserved"
    assert license_scan.scan_licenses(nothing).count() == 0


# 3 and 7: the automaton


def test_automaton_statistics_match_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        items = [[rng.choice("abc").encode() for _ in range(rng.randint(1, 8))] for _ in range(rng.randint(1, 4))]
        text = [rng.choice("abcd").encode() for _ in range(30)]
        least = rng.randint(1, 3)
        matcher = Matcher(items, least)
        got = {at: n for at, n, _ in matcher.statistics(matcher.ids(text))}
        occurs = lambda part: any(item[i : i + len(part)] == part for item in items for i in range(len(item)))
        for at in range(len(text)):
            longest = max((n for n in range(1, at + 2) if occurs(text[at + 1 - n : at + 1])), default=0)
            assert got.get(at, 0) == (longest if longest >= least else 0)


def test_automaton_knows_owners():
    sam = SuffixAutomaton([[1, 2, 3], [2, 3, 4], [5]])
    state = sam.next[sam.next[0][2]][3]
    assert sam.owners[state] == (0, 1) and sam.owners[sam.next[0][5]] == (2,)


# 4 token files


def test_token_files_round_trip(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    texts = docs_of(spark, sf)
    start = 0
    got = {r["doc_id"]: r for r in registry.QUERIES["op4_token_files"](spark, sf).collect()}
    for key in sorted(texts):
        ids = np.array(tokenizer.encode(texts[key], add_special_tokens=False).ids + [1], dtype="<u4")
        assert (got[key]["start"], got[key]["n_tokens"], got[key]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pieces_are_the_library_s():
    encoder = token_files.PieceEncoder(common.tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(2)
    letters = "abXYZ '’!?.,-_<|>0129²½ªº×ñÑßÀİıſΣς́ \x85\x1c\t\n 你😀éÅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(500)] + ["<|endoftext|>a", "I'LL don't", "", None]
    for text, got in zip(texts, encoder.encode(texts)):
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids if text else []
        assert got == np.array([*ids, 1], dtype="<u4").tobytes()


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A tokenizer with another normaliser is told from its file, and its ids are the library's too."""
    import json

    own = json.load(open(common.tokenizer_path("word_bpe_49k.json")))
    own["normalizer"] = {"type": "Sequence", "normalizers": own["normalizer"]["normalizers"][:2]}
    (tmp_path / "other.json").write_text(json.dumps(own))
    encoder = token_files.PieceEncoder(str(tmp_path / "other.json"))
    assert not encoder.by_piece and token_files.PieceEncoder(common.tokenizer_path("word_bpe_49k.json")).by_piece
    for text in ("Some Words THERE", "naïve"):
        assert encoder.encode([text])[0][:-4] == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_frames_are_independent_and_checked(tmp_path):
    path = tmp_path / "x.zst"
    rng = np.random.default_rng(1)
    docs = [(i if i % 5 else None, rng.integers(0, 50_000, rng.integers(0, 3000), dtype=np.uint32).astype("<u4").tobytes()) for i in range(60)]
    with open(path, "wb") as out:
        writer = token_files.FrameWriter(out, frame_bytes=4096)
        for d in docs:
            writer.add(*d)
        writer.close()
    from pyarrow import fs

    reader = token_files.FrameReader(fs.LocalFileSystem().open_input_file(str(path)))
    order = list(range(60))
    random.Random(0).shuffle(order)
    for k in order:
        assert reader.doc_ids[k] == docs[k][0] and reader.document(k).tobytes() == docs[k][1]
    import zstandard  # a reader that knows nothing of the seek table reads the whole

    whole = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert whole == b"".join(d for _, d in docs)
    data = bytearray(path.read_bytes())
    data[40] ^= 0xFF
    path.write_bytes(data)
    damaged = token_files.FrameReader(fs.LocalFileSystem().open_input_file(str(path)))
    with pytest.raises(Exception):
        damaged.document(0)


def test_token_files_edge_cases(spark, hostile, nothing):
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    parts = token_files.write_files(hostile, folder, common.tokenizer_path("word_bpe_49k.json")).collect()
    assert sum(p["n_docs"] for p in parts) == hostile.count()
    again = folder + "/again"
    files = token_files.write_index(token_files.write_files(hostile, again, common.tokenizer_path("word_bpe_49k.json")), again)
    got = token_files.read_files(files, again).orderBy("start").collect()
    texts = hostile.orderBy(hostile["doc_id"].asc_nulls_first()).collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in texts] and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))
    assert {r["n_tokens"] for r in got if r["doc_id"] in (4, 5)} == {1}
    none = folder + "/none"
    assert token_files.read_files(token_files.write_index(token_files.write_files(nothing, none, common.tokenizer_path("word_bpe_49k.json")), none), none).count() == 0
    assert token_files.write_files(nothing, folder + "/e", common.tokenizer_path("word_bpe_49k.json")).collect() == []


# 5 SentencePiece


def test_sentencepiece_is_the_library_s(spark, sf):
    import sentencepiece

    path = common.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = docs_of(spark, sf)
    for r in sentencepiece_codec.encode_texts(spark.read.parquet(f"{sf}/documents.parquet"), path).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["same"]
        assert r["ids_crc32"] == zlib.crc32(array("i", r["ids"]).tobytes())


def test_sentencepiece_random_and_unigram():
    import sentencepiece

    path = common.tokenizer_path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.load_model(path)
    rng = random.Random(4)
    for _ in range(800):
        text = "".join(rng.choice("abcdeht inrgTHE  ▁\n\t.,!?01éñ你😀\x00<>s") for _ in range(rng.randint(1, 40)))
        assert list(array("i", model.encode(text))) == library.encode(text)
        assert model.encode_both(text) == (model.encode(text), sentencepiece_codec.load_model(path, "unigram").encode(text))
    pieces = {p: (i, s) for i, (p, s) in enumerate({"▁": -2.0, "a": -3.0, "b": -3.0, "ab": -4.0, "▁a": -3.5, "ba": -3.2, "bab": -8.0, "▁ab": -7.0}.items())}
    unigram = sentencepiece_codec.PieceModel(pieces, list(range(100, 356)), "unigram")
    assert unigram.score(unigram.encode("ab")) == -6.0

    def best(text):
        return max([pieces[text[:k]][1] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in pieces], default=-1e9) if text else 0.0

    for text in ("▁" + "".join(x) for n in range(1, 7) for x in itertools.product("ab", repeat=n)):
        assert abs(sum(pieces[unigram.names[p]][1] for p in unigram.best(text)) - best(text)) < 1e-9


def test_best_scores_match_brute_force(spark):
    """The largest sum of scores over all ways to cut a text into pieces, for words of the public file."""
    import sentencepiece

    path = common.tokenizer_path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.load_model(path, "unigram")

    def best(text):
        table = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                part = text[start:end]
                score = model.pieces[part][1] if part in model.pieces else model.unknown if end - start == 1 else -np.inf
                table[end] = max(table[end], table[start] + score)
        return table[-1]

    docs = spark.createDataFrame([(1, "the quick brown foxes jump"), (2, "naïve 你好 and 12345  blanks\nlines"), (3, ""), (4, None)], "doc_id long, text string")
    for r in sentencepiece_codec.best_scores(docs, path, keep=("doc_id", "text")).collect():
        text = ("▁" + r["text"].replace(" ", "▁")) if r["text"] else ""
        known = [x for x in model.best(text) if x >= sentencepiece_codec.ALONE]
        assert abs(sum(model.pieces[model.names[x]][1] if x < sentencepiece_codec.ALONE else model.unknown for x in model.best(text)) - best(text)) < 1e-6
        assert r["best_same"] and r["same"] and r["n_ids"] == len(library.encode(r["text"] or ""))
        assert r["best_score"] >= r["ids_score"] - 1e-6 and (known or abs(r["best_score"] - best(text)) < 1e-6)


def test_sentencepiece_edge_cases(hostile, nothing):
    path = common.tokenizer_path("piece_bpe_32k.model")
    rows = sentencepiece_codec.encode_texts(hostile, path, keep=tuple(hostile.columns)).collect()
    assert len(rows) == hostile.count() and all(r["same"] for r in rows)
    assert all(r["ids"] is None and r["n_ids"] == 0 for r in rows if r["doc_id"] == 4)
    back = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_texts(hostile, path), path)
    assert sorted(str(r["text"]) for r in back.collect()) == sorted(str(r["text"]) for r in hostile.select("text").collect())
    assert sentencepiece_codec.encode_texts(nothing, path).count() == 0


# 6 sharding


def test_shards_are_nearly_equal_and_gapless(spark):
    rows = registry.QUERIES["op6_sharding"](spark, "/root/testdata/sf0.01").collect()
    texts = docs_of(spark, "/root/testdata/sf0.01")
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data) and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(load.values()) < 1.01 * min(load.values()) and len(load) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rebalance_edits_the_map():
    rng = random.Random(0)
    sizes = {k: rng.randint(1, 1000) for k in range(512)}
    before = sharding.initial_map(512, 8)
    after = sharding.rebalance(before, sizes, 8)
    load = [sum(sizes[k] for k in sizes if after[k] == s) for s in range(8)]
    assert max(load) - min(load) <= 0.01 * sum(load) / 8
    assert sum(a != b for a, b in zip(before, after)) < 100  # most slots stay where they are
    assert sharding.rebalance(after, sizes, 8) == after


def test_rebalance_is_near_the_best_of_all_moves():
    """Steps chosen among all moves and swaps give no smaller gap."""
    rng = random.Random(3)
    for _ in range(20):
        sizes = {k: rng.randint(1, 300) for k in range(40)}
        plain = [k % 4 for k in range(40)]
        while True:
            load = [sum(sizes[k] for k in range(40) if plain[k] == s) for s in range(4)]
            high, low = load.index(max(load)), load.index(min(load))
            gap, mean = load[high] - load[low], sum(load) / 4
            gives, takes = [k for k in range(40) if plain[k] == high], [None, *(k for k in range(40) if plain[k] == low)]
            moves = [(abs(gap - 2 * m), a, b) for a in gives for b in takes if 0 < (m := sizes[a] - (sizes[b] if b is not None else 0)) < gap]
            if gap <= 1e-4 * mean or not moves:
                break
            _, a, b = min(moves, key=lambda x: x[0])
            plain[a] = low
            if b is not None:
                plain[b] = high
        after = sharding.rebalance([k % 4 for k in range(40)], sizes, 4)
        own = [sum(sizes[k] for k in range(40) if after[k] == s) for s in range(4)]
        assert max(own) - min(own) <= gap + 0.02 * mean


def test_three_batches_edit_the_stored_map(spark):
    """Versions 1 to 4 stay readable, a slot's bytes add up, few slots move, and a version is written once."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path, sizes = tempfile.mkdtemp(prefix="spark-") + "/map", collections.Counter()
    for k in range(3):
        part = docs.where(f"doc_id % 3 = {k}")
        own = sharding.slot_sizes(sharding.with_slots(part, 256)).collect()
        sizes.update({r["virtual_slot"]: r["n_bytes"] for r in own})
        table = sharding.add_batch(spark, path, sharding.slot_sizes(sharding.with_slots(part, 256)), 256, 4)
        rows = table.collect()
        assert {r["version"] for r in rows} == {k + 2} and {r["virtual_slot"]: r["n_bytes"] for r in rows if r["n_bytes"]} == sizes
        load = collections.Counter()
        for r in rows:
            load[r["shard"]] += r["n_bytes"]
        assert max(load.values()) < 1.01 * min(load.values())
    assert [r["shard"] for r in sharding.read_map(spark, path, 1).orderBy("virtual_slot").collect()] == [k % 4 for k in range(256)]
    assert 0 < sharding.moved(spark, path, 3, 4).count() < 60 and sharding.read_map(spark, path, 9) is None
    with pytest.raises(Exception):
        sharding.store_map(spark, path, [(4, 0, 0, 0, 0)])


def test_repeats_of_one_row_spread(spark, monkeypatch):
    """A document repeated 300 times beside 1,000 others: sizes stay near equal, positions gapless, and no slot holds them all."""
    monkeypatch.setattr(sharding, "PORTION", 64)  # several portions
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    often = docs.where("length(text) > 1500").orderBy("doc_id").limit(1)
    rows = docs.unionByName(often.crossJoin(spark.range(300)).select("doc_id", "text"))
    placed, table = sharding.shard(rows, tempfile.mkdtemp(prefix="spark-") + "/map")
    load, slots, own = collections.Counter(), collections.defaultdict(list), collections.Counter()
    hot = often.first()["doc_id"]
    for r in placed.collect():
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        own[r["virtual_slot"]] += r["doc_id"] == hot
    assert sum(map(len, slots.values())) == rows.count() and sum(own.values()) == 301
    assert max(load.values()) < 1.01 * min(load.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(own.values()) < 6
    folder = tempfile.mkdtemp(prefix="spark-")
    sharding.write_shards(rows, folder + "/out")
    written = {r["shard"]: r["n"] for r in spark.read.parquet(folder + "/out/data").selectExpr("shard", "octet_length(text) + 1 AS b").groupBy("shard").agg({"b": "sum"}).toDF("shard", "n").collect()}
    assert sum(written.values()) == sum(load.values()) and max(written.values()) < 1.02 * min(written.values())


def test_sharding_edge_cases(spark, hostile, nothing):
    folder = tempfile.mkdtemp(prefix="spark-")
    placed, table = sharding.shard(hostile, folder + "/map")
    rows = placed.collect()
    assert len(rows) == hostile.count() and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert all(r["size"] == 1 for r in rows if r["doc_id"] in (4, 5))
    placed, table = sharding.shard(nothing, folder + "/none")
    assert placed.count() == 0 and table.count() == sharding.N_SLOTS
    assert sharding.write_shards(hostile, folder + "/out") == 2
    assert sharding.write_shards(hostile.where("doc_id = 1"), folder + "/out") == 3
    assert spark.read.parquet(folder + "/out/data").count() == hostile.count() + 2


# 7 decontamination


def test_short_items_and_blocks(spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:15])), (2, "Tiny item"), (3, " ".join(words[5:25])), (4, ""), (5, None), (None, "null id"), (2, "Tiny item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words[3:14]) + " y"), (2, "a tiny item, b"), (3, "tiny other item"), (4, None), (5, "null id"), (5, "null id")], "doc_id long, text string")
    whole = sorted(map(str, decontamination.scan(docs, items).collect()))
    assert whole == sorted(map(str, decontamination.scan(docs, items, block_words=10).collect()))
    assert whole == sorted(map(str, decontamination.scan(docs, items, block_words=12).collect()))
    got = {r["doc_id"]: r for r in decontamination.scan(docs, items).collect()}
    assert got[1]["items"] == ["1"] and got[1]["starts"] == [1] and got[1]["ends"] == [12]
    assert got[2]["items"] == ["2"] and got[3]["items"] == [] and got[4]["n_words"] == 0
    assert got[5]["items"] == [] and got[5]["starts"] == [0]


def test_decontaminate_removes_spans(spark, hostile, nothing):
    words = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, words)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before, it was long enough to stay in the corpus. {words.upper()}! After it."), (2, words), (3, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, items).collect()}
    assert got == {1: "Before, it was long enough to stay in the corpus. ! After it.", 3: "clean"}
    kept = decontamination.decontaminate(hostile, items)
    assert kept.columns == hostile.columns and kept.count() == hostile.count()
    assert decontamination.decontaminate(nothing, items).count() == 0
    assert decontamination.decontaminate(hostile, items.where("false")).count() == hostile.count()


# 8 edit-aware counts


def test_edits_match_whole_encoding():
    count = edit_counts.counter(common.tokenizer_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    letters = "abc the  \n.'s12é !  "
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40, 400, 3000])))
        tree = edit_counts.TokenTree.of(text, count)
        for _ in range(5):
            start, n = rng.randint(0, len(text) + 2), rng.randint(0, rng.choice([0, 3, 30, 500]))
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 30, 700])))
            tree.edit(start, n, new)
            start = min(start, len(text))
            text = text[:start] + new + text[start + n :]
            assert tree.text() == text and tree.n_tokens == len(count.encoding.encode_ordinary(text))
            assert sum(tree.pieces) == len(count.cut.findall(text))
            chars, pieces, tokens = tree.stored()  # a tree restored from the store goes on where it was
            ends = np.cumsum(chars).tolist()
            tree = edit_counts.TokenTree(count, [text[b - a : b] for a, b in zip(chars, ends)], pieces, tokens)
            assert tree.text() == text and tree.n_tokens == len(count.encoding.encode_ordinary(text))


def test_edit_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    count = edit_counts.counter(common.tokenizer_path("byte_bpe_50k.tiktoken"))
    tokens = lambda t: len(count.encoding.encode_ordinary(t))
    texts, steps = docs_of(spark, sf), []
    for batch in (0, 1):
        edits = collections.defaultdict(list)
        now = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        for e in edit_counts.edit_log(now, batch=batch).collect():
            edits[e["doc_id"]].append((e["seq"], e["start"], e["n_deleted"], e["inserted"]))
        steps.append({k: tokens(t) for k, t in texts.items()})
        for key, own in edits.items():
            for _, start, n, new in sorted(own):
                texts[key] = texts[key][:start] + new + texts[key][start + n :]
    for r in registry.QUERIES["op8_edit_counts"](spark, sf).collect():
        text = texts[r["doc_id"]]
        assert (r["n_before"], r["n_middle"]) == (steps[0][r["doc_id"]], steps[1][r["doc_id"]])
        assert r["text_crc32"] == zlib.crc32(text.encode()) and r["n_after"] == tokens(text)
        assert max(r["n_recounted"], r["n_again"]) <= max(3 * 40 * edit_counts.LEAF, r["n_pieces"])


def test_edit_edge_cases(spark, hostile, nothing):
    path = common.tokenizer_path("byte_bpe_50k.tiktoken")
    got = edit_counts.count_after_edits(hostile, edit_counts.edit_log(hostile), path).collect()
    assert len(got) == hostile.count() and all(r["n_before"] == 0 for r in got if r["doc_id"] in (4, 5))
    assert {r["n_edits"] for r in got} == {3}  # rows that repeat a doc_id don't multiply its edits
    none = edit_counts.count_after_edits(hostile, edit_counts.edit_log(nothing), path).collect()
    assert all(r["n_before"] == r["n_after"] and r["n_edits"] == 0 for r in none)
    assert edit_counts.count_after_edits(nothing, edit_counts.edit_log(hostile), path).count() == 0


# 9 toxicity


def test_toxicity_learns_and_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.QUERIES["op9_toxicity"](spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.85


def test_toxicity_held_out_accuracy_with_enough_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in registry.QUERIES["op9_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic = [r["predicted"] for r in held if labels[r["doc_id"]]]
    clean = [r["predicted"] for r in held if not labels[r["doc_id"]]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03


def small_model():
    model = toxicity.Model(3)
    for name in ("e", "v", "c"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.w, model.b = [x.astype(np.float64) for x in model.w], [np.full_like(x, 0.02, dtype=np.float64) for x in model.b]
    return model


def naive_logit(model, rows):
    """The network word by word, filter by filter: windows that hang over the end take what is there."""
    x = [sum(model.e[b] for b in word) for word in rows]
    out = model.c[0]
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            values = [model.b[k][f] + sum(float(x[i + s] @ model.w[k][s * toxicity.DIM : (s + 1) * toxicity.DIM, f]) for s in range(width) if i + s < len(x)) for i in range(len(x))]
            out += model.v[k * toxicity.FILTERS + f] * max(0.0, max(values, default=0.0))
    return out


def test_forward_pass_matches_a_loop():
    model, texts = small_model(), [b"one two three four five", b"solo", b"", "más ñandú así y así".encode(), b"w " * 30]
    buckets, counts, _ = toxicity.features(texts)
    ends = np.cumsum(counts)
    expected = [naive_logit(model, buckets[e - n : e]) for e, n in zip(ends, counts)]
    assert np.allclose(model.logits(buckets, counts), expected, atol=1e-5)


def test_gradients_match_differences():
    model, texts, y = small_model(), [b"one two three two one", b"four", b"five six seven eight nine ten"], np.array([1.0, 0.0, 1.0])
    buckets, counts, _ = toxicity.features(texts)
    ends = np.cumsum(counts)

    def loss():
        z = np.array([naive_logit(model, buckets[e - n : e]) for e, n in zip(ends, counts)])
        return float(np.mean(np.log1p(np.exp(-z)) + (1 - y) * z))

    grads, touched, ge = toxicity.gradients(model, buckets, counts, y)
    rng = np.random.default_rng(0)
    params = [*model.w, *model.b, model.v, model.c]
    places = [(p.reshape(-1), g.reshape(-1), i) for p, g in zip(params, grads) for i in rng.choice(p.size, min(4, p.size), replace=False)]
    places += [(model.e[t], ge[k], i) for k, t in enumerate(touched[:6]) for i in (0, 5)]
    for values, slope, i in places:
        kept, h = values[i], 1e-6
        values[i] = kept + h
        up = loss()
        values[i] = kept - h
        down = loss()
        values[i] = kept
        assert abs((up - down) / (2 * h) - slope[i]) < 1e-6


def test_languages_are_told():
    texts = {"en": "the cat is on the roof of a house and it was there", "es": "el gato no es de los vecinos y se va por las calles", "de": "der Hund ist nicht im Haus und die Katze auf dem Dach",
             "fr": "le chat est dans la maison et les chiens ne sont pas sur le toit", "it": "il gatto che non sono della casa per gli amici", "cyrillic": "кошка сидит на крыше", "han": "猫在屋顶上", "other": "zzz qqq"}
    _, _, got = toxicity.features([t.encode() for t in texts.values()])
    assert [toxicity.LANGUAGES[k] for k in got] == list(texts)


def test_scores_do_not_depend_on_the_batch():
    model = toxicity.Model()
    texts = [b"one two three", None, b"", b"solo", "Ñandú más así".encode(), b"w " * 3000]
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts], atol=1e-6)


def test_toxicity_edge_cases(spark, hostile, nothing):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(hostile, labels) is None
    got = toxicity.score(hostile, None).collect()
    assert len(got) == hostile.count() and all(r["score"] == 0 for r in got)
    assert toxicity.score(nothing, None).count() == 0 and toxicity.fit(nothing, labels) is None


def test_toxicity_learns_from_every_labelled_row(spark):
    # more rows of either label than any bounded sample took; every text is one word of its own
    rows = spark.range(16_000).selectExpr("id AS doc_id", "concat('word', id) AS text", "CAST(id % 2 AS INT) AS toxic")
    model = toxicity.fit(rows.select("doc_id", "text"), rows.selectExpr("doc_id", "1 AS quality", "toxic"))
    taught = [r["text"].encode() for r in rows.where(~toxicity.held_out()).where("pmod(xxhash64(doc_id, 'toxicity'), 5) > 0").collect()]
    assert len(taught) > 2 * toxicity.SHARD_ROWS
    whole = toxicity.features(taught)[0][:, 0]
    assert (np.abs(model.e[whole]).sum(axis=1) > 0).all()


def test_toxicity_model_does_not_depend_on_tasks(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 60)
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    one = toxicity.fit(docs, labels)
    other = toxicity.fit(docs.repartition(7), labels.repartition(5))
    assert all((a == b).all() for a, b in zip([one.e, one.thresholds, *one.dense()], [other.e, other.thresholds, *other.dense()]))


def test_toxicity_thresholds_from_counts():
    model = toxicity.Model()
    # in one language: clean at -2 and 1, toxic at 3 and, one of many, at -3
    language, cell = np.array([1, 1, 1, 1]), np.array([-2, 1, 3, -3]) * toxicity.CELLS
    toxicity.set_thresholds(model, language, cell, np.array([500, 500, 0, 0]), np.array([0, 0, 999, 1]))
    everyone = 1000 * 2 / (1000 + toxicity.PRIOR)
    assert np.isclose(model.thresholds[0], everyone) and np.isclose(model.thresholds[1], (1000 * 2 + toxicity.PRIOR * everyone) / (1000 + toxicity.PRIOR))


# 10 near-dedup


def bag(text):
    words = plain(text)
    return collections.Counter(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else None


def brute_classes(rows):
    """Class ids of (doc_id, text) rows by comparing all pairs that share a shingle."""
    bags, share = {}, collections.defaultdict(set)
    for key, text in rows:
        bags[key] = bag(text)
        for s in bags[key] or ():
            share[s].add(key)
    parent = {k: k for k in bags}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in {p for own in share.values() for p in itertools.combinations(sorted(own), 2)}:
        both = sum((bags[a] & bags[b]).values())
        if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in bags}


def test_near_classes_match_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    expected = brute_classes(docs_of(spark, sf).items())
    got = {r["doc_id"]: r["class_id"] for r in registry.QUERIES["op10_bagminhash"](spark, sf).collect()}
    assert got == expected


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    a = collections.Counter(rng.integers(0, 60, 200).tolist())
    b = a + collections.Counter(rng.integers(0, 90, 100).tolist())
    truth = sum((a & b).values()) / sum((a | b).values())

    def registers(c, seed):
        elements = near_dedup.mix(np.array(list(c), np.uint64) + np.uint64(1000 * seed))
        return near_dedup.signatures(np.zeros(len(c), np.int64), elements, np.array(list(c.values())), 1, 256)

    got = np.mean([(registers(a, s) == registers(b, s)).mean() for s in range(100)])
    assert abs(got - truth) < 0.012


def test_a_large_group_of_near_copies(spark):
    """Edits of one text at many rates: classes agree with brute force although most pairs are below the threshold."""
    rng = random.Random(7)
    words = [f"v{rng.randint(0, 5000)}" for _ in range(150)]
    texts = []
    for i in range(220):
        own = list(words)
        for _ in range(i % 14):
            own[rng.randrange(len(own))] = f"e{rng.randint(0, 10**6)}"
        texts.append((i, " ".join(own)))
    expected = brute_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == expected


def test_pairs_at_the_threshold_that_meet_through_a_centre(spark):
    """Bags of 31 and 32 shingles that share 28 lie inside a long text: similarity 0.8 exactly, seen only beside the centre."""
    w = [f"u{i}" for i in range(80)]
    a, b = w[0:35], w[3:39]
    texts = [(1, " ".join(a)), (2, " ".join(b)), *((10 + i, " ".join([*w[:60], f"x{i}", *w[60:]])) for i in range(6))]
    assert bag(texts[0][1]).total() == 31 and (bag(texts[0][1]) & bag(texts[1][1])).total() == 28
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_classes(texts) and got[1] == got[2] != got[10]


def test_near_edge_cases(spark, hostile, nothing):
    rows = near_dedup.near_classes(hostile).collect()
    assert len(rows) == hostile.count()
    classes = collections.defaultdict(set)
    for r in rows:
        classes[r["doc_id"]].add(r["class_id"])
    assert classes[1] == classes[2] == classes[3] == classes[14] and classes[9] != classes[10]
    kept = near_dedup.near_dedup(hostile)
    assert kept.columns == hostile.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and sum(i in (None, 1, 2, 3, 14) for i in ids) == 2  # a null text with a null id is its own
    assert near_dedup.near_classes(nothing).count() == 0 and near_dedup.near_dedup(nothing).count() == 0


# the pipeline


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    verdict = {r["doc_id"] for r in registry.QUERIES["op1_quality_rules"](spark, sf).where("kept").collect()}
    texts = {k: t for k, t in docs_of(spark, sf).items() if k in verdict}
    classes = brute_classes(texts.items())
    texts = {k: t for k, t in texts.items() if classes[k] == k}
    short = brute_spans(sorted(texts.items()))
    texts = {k: t for k, t in short.items() if t == texts[k] or t.strip()}
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = plain(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    for key in list(texts):
        w = plain(texts[key])
        hit = {i + j for i in range(len(w)) for n in {len(x) for x in windows} if tuple(w[i : i + n]) in windows for j in range(n)}
        if len(hit) > 0.5 * len(w):
            del texts[key]
        else:
            texts[key] = [x for i, x in enumerate(w) if i not in hit]
    assert {k: plain(r["text"]) if not isinstance(texts.get(k), str) else r["text"] for k, r in got.items()} == texts
    assert [name for name, _ in corpus_pipeline.STAGES] and all(r["same"] for r in got.values())
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf).columns == docs.columns


def test_stages_take_hostile_tables(spark, hostile):
    """Every stage by itself, and all in turn: columns stay, clean rows stay, repeats of one document become one row."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, hostile, "/root/testdata/sf0.001")
        assert name == "sentencepiece" or out.columns == hostile.columns
        assert {7, 11, 13} <= {r["doc_id"] for r in out.select("doc_id").collect()} or name == "quality rules"
    docs = hostile
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert set(ids) >= {11, 15} and len(ids) == len(set(ids)) and sum(i in (None, 1, 2, 3, 14) for i in ids) == 1


def test_stages_take_empty_tables(spark, nothing):
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0
