"""Collocations, license scans and the Merkle manifest against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from re import _parser as sre

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoregate.llm import collocations as co
from scoregate.llm import license_rules as rules
from scoregate.llm import merkle
from scoregate.llm.license_scan import license_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))


# Collocations


def phrase_counts(rows):
    """Counts of all phrases of up to three words of each language, and how often a word stands before and after."""
    f, before, after, total = {}, Counter(), Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    g = tuple(w[i : i + k])
                    own[g] += 1
                    before[lang, g] += i > 0
                    after[lang, g] += i + k < len(w)
    return f, before, after, total


def best_phrases(rows, least, percent, most):
    f, before, after, total = phrase_counts(rows)
    out = []
    for lang, c in f.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        around = Counter()
        for g, a in found.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    around[part] = max(around[part], a)
        own = []
        for g, a in found.items():
            if len(g) == 2 and around[g] and 100 * around[g] >= percent * a:
                continue
            score, k = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            own.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]], g))
        out += [
            (lang, i + 1, p.decode(), -a, left, right, total[lang], -s, before[lang, g], after[lang, g])
            for i, (s, a, p, left, right, g) in enumerate(sorted(own)[:most])
        ]
    return sorted(out)


def texts(seed, n=120, hot=False):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "naïve", "A\x01b", "日本", "The", "x" * 70]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 60)):
            parts.append("new york city" if hot and rng.random() < 0.4 else rng.choice(vocabulary))
            parts.append(rng.choice((" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\x0b", " ", ";!")))
        out.append(("".join(parts), rng.choice(("en", "en", None, "und", "fr"))))
    return out + [(None, "en"), ("", "xx"), (" .\t!", "en")]


@pytest.mark.parametrize("seed,hot,shard", [(0, False, 1 << 21), (1, True, 1 << 21), (2, False, 37), (3, True, 5)])
def test_collocations(spark, monkeypatch, seed, hot, shard):
    monkeypatch.setattr(co, "SHARD", shard)
    rows = texts(seed, hot=hot)
    df = spark.createDataFrame([(t, x, 1) for t, x in rows], "text string, lang string, phrase int").repartition(3)
    got = co.collocations(df, least=4, covered_percent=50, most=60)
    assert sorted(map(tuple, got.collect())) == best_phrases(rows, 4, 50, 60)


@pytest.mark.parametrize("seed", range(4))
def test_index_of_a_shard(seed):
    """Intervals of both transforms give each phrase's count and what stands around it; nothing is missing, nothing else there."""
    rows = [(t, "en") for t, _ in texts(seed, 30)]
    everything = co.Sieve(np.full(co.SIEVE_BITS >> 6, (1 << 64) - 1, np.uint64))
    f, before, after, _ = phrase_counts(rows)
    runs = list(co.words_and_pieces(pa.array([t for t, _ in rows])))
    words, fresh = pa.concat_arrays([w for w, _ in runs]).dictionary_encode(), np.concatenate([x for _, x in runs])
    for length in (1, 2, 3):
        got = {}
        for phrases, found in co.phrases_of(words, fresh, "en", length, everything):
            for p, n, b, a in zip(phrases.to_pylist(), found.n.tolist(), found.before.tolist(), found.after.tolist(), strict=True):
                got[tuple(p.split(" "))] = n, b, a
        assert got == {g: (n, before["en", g], after["en", g]) for g, n in f["en"].items() if len(g) == length}


def test_index_with_many_symbols_sorts_alike(monkeypatch):
    sequence = np.random.default_rng(1).integers(0, 9, 500).astype(np.int32)
    want = co._transform(sequence, 9, 3)
    order = sorted(range(500), key=lambda i: [sequence[(i + k) % 500] for k in range(3)])
    keys = lambda at: [[sequence[(i + k) % 500] for k in range(3)] for i in at]
    assert keys(order) == sorted(keys(range(500)))
    for other in (co._transform(sequence, 1 << 40, 3), sequence[np.array(order) - 1]):  # equal suffixes may change places
        at = 0
        for n in Counter(map(tuple, keys(order))).values():
            assert sorted(want[at : at + n]) == sorted(other[at : at + n])
            at += n


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 123_456_789_012_345, 987_654_321_098_765, 222_222_222_222_223
    got = spark.range(1).select(F.lit(a).alias("a")).select(co._score(F.lit(left), F.lit(right)).alias("s")).first()["s"]
    assert got == 1_000_000 * a * a // (left * right)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert co.collocations(empty).collect() == []
    assert co.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).collect() == []


# License scans


def scanned(text):
    """The rules' matches by plain regular expressions and a look at all pairs."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    line = " ".join(words)
    found = []
    for i, r in enumerate(rules.RULES):
        for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", line):
            first = line[: m.start()].count(" ")
            found.append((first, first + m.group().count(" "), i))
    base = [x for x in found if x[2] < len(rules.BASE)]
    inside = lambda x, y: y[0] <= x[0] and y[1] >= x[1] and (y[:2] != x[:2] or y[2] < x[2])
    left = sorted(x for x in found if not any(inside(x, y) for y in found if y != x))
    worse = lambda x, y: y[0] <= x[1] and x[0] <= y[1] and y[2] < x[2]
    kept = [x for i, x in enumerate(left) if not any(worse(x, y) for y in left[max(0, i - 1) : i] + left[i + 1 : i + 2])]
    labels = lambda xs: ",".join(sorted({rules.RULES[x[2]].label for x in xs}))
    starts = [x[0] for x in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), labels(base), labels(base + kept),
        max((rules.RULES[x[2]].weight for x in base + kept), default=0.0), [(rules.RULES[x[2]].label, x[0], x[1], x[2]) for x in kept],
    )


def sample(parsed, rng):
    """A text that a pattern matches."""
    out = ""
    for what, value in parsed:
        what = str(what)
        if what == "LITERAL":
            out += chr(value)
        elif what == "NOT_LITERAL":
            out += "y"
        elif what == "SUBPATTERN":
            out += sample(value[3], rng)
        elif what == "BRANCH":
            out += sample(rng.choice(value[1]), rng)
        elif what in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            out += "".join(sample(inner, rng) for _ in range(rng.randint(low, min(high, low + 2))))
        elif what == "IN":
            kind, x = rng.choice(value)
            out += chr(x) if str(kind) == "LITERAL" else "7"
        elif what == "ASSERT":
            out += ""
        else:
            raise AssertionError(what)
    return out


def test_rules_are_gated_by_what_they_match():
    rng = random.Random(4)
    short = re.compile(rf"(?:^|[^a-z0-9])(?:{'|'.join(rules.SHORT_GATES)})(?:[^a-z]|v|$)")
    assert len(rules.RULES) > 300
    for r in rules.RULES:
        parsed = sre.parse(r.pattern)
        for _ in range(40):
            text = sample(parsed, rng)
            assert r.keyword in text, r
            assert any(g in text for g in rules.GATES) or short.search(text), (r, text)
            assert len(text.split(" ")) <= rules.MOST_WORDS, r


def test_license_scan(spark):
    rng = random.Random(6)
    picked = [sample(sre.parse(r.pattern), rng) for r in rng.sample(rules.RULES, 120)]
    bits = picked + [
        "MIT", "License", "mit-license", "GNU", "General Public License", "version", "2", "or later", "Lesser", "é", "x",
        "permit", "K", "İ", "Licensed under the", "the", ".", "\n"
    ] * 4
    made = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(250)]
    made += [None, "", " . ", "MIT\nLicense; Apache License, the GNU General Public License v3. MIT LICENSE"]
    rows = [(None if i == 3 else i, t, 7, "mine") for i, t in enumerate(made)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, found string")
    got = Counter()
    for r in license_scan(df).collect():
        assert r["found"] == "mine" and isinstance(r["score"], float)
        got[
            r["text"],
            str(
                (
                    r.n_words,
                    r.n_base,
                    r.first_word,
                    r.last_word,
                    r.base_labels,
                    r.labels,
                    r.score,
                    [(p.label, p.start, p.end, p.rule) for p in r.places]
                )
            )
        ] += 1
    assert got == Counter((t, str(scanned(t))) for t in made)
    assert license_scan(spark.createDataFrame([], DOCS)).collect() == []


def test_license_scan_of_a_text_with_very_many_places(spark):
    text = "mit license gpl v2 " * 20_000
    r = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, len(r.places)) == (80_000, 20_000, 0, 79_996, 40_000)


def test_license_scan_runs_no_python(spark, sf_dir):
    plan = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows):
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(framed, (r[0], r[3], r[2], r[4], r[1])))

    def grown(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, i):
        for level in levels[:-1]:
            run = i // 16 * 16
            yield level[run:i], level[i + 1 : run + 16]
            i //= 16

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, grown([leaf(r) for r in own])
    top = grown([trees[s][1][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        own, levels = trees[s]
        for i, r in enumerate(own):
            steps = [*way(levels, i), *way(top, j)]
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf((r[0], lowered(r[1]) if r[1] is not None else None, *r[2:]))
            for before, after in steps:
                node = h(*before, node, *after)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], h(*(x for b, a in steps for x in b + a)), node, node == top[-1][0]))
    return sorted(out, key=str)


def proven(df):
    return merkle.merkle_manifest(df, tampered=(merkle.is_tampered(F.col("doc_id")), "text", merkle.lowered_text()))


def rows_of(n, sources, seed=0):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    return [(i * 3, pick(None, "", f"Text {i}", "ABC", "é1:2"), pick(None, "en", "fr"), rng.choice(sources), pick(None, i)) for i in range(n)]


@pytest.mark.parametrize(
    "n,sources",
    [
        (1, ["s"]),
        (2, [None]),
        (16, ["s"]),
        (17, ["s"]),
        (300, ["s", "t"]),
        (700, ["s", "s", "s", None, "", "É", *map(str, range(30))]),
        (600, [str(i) for i in range(600)])
    ]
)
def test_manifest(spark, n, sources):
    rows = rows_of(n, sources)
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("own") for c in ("tree", "pos", "digest", "key", "block", "now")}).repartition(3)
    assert sorted(map(tuple, proven(df).collect()), key=str) == manifest(rows)


def test_manifest_with_more_rounds(spark, monkeypatch):
    """Blocks of one level, so that trees need many rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = rows_of(4500, ["s", "t"], 2)
    # the tasks read the same numbers from what is shipped with them, so the whole is compared on the driver's side too
    assert merkle.levels_of(4500) == 1
    nodes = [h(str(i)) for i in range(40)]
    assert merkle.reduced(nodes, 2)[-1] == [h(h(*nodes[:16]), h(*nodes[16:32]), h(*nodes[32:]))]
    monkeypatch.undo()
    assert sorted(map(tuple, proven(spark.createDataFrame(rows, DOCS)).collect()), key=str) == manifest(rows)


def test_manifest_cases(spark):
    rows = [
        (None, "A", "en", "s", 1),
        (None, None, None, None, None),
        (2**60 + 1, "x", "en", "s", 1),
        (2**60 + 1, "x", "en", "s", 1),
        (2**60 + 1, "y", "en", "s", 1)
    ]
    assert sorted(map(tuple, proven(spark.createDataFrame(rows, DOCS)).collect()), key=str) == manifest(rows)
    assert proven(spark.createDataFrame([], DOCS)).collect() == []


def test_proofs_fold_to_the_root(spark):
    rows = rows_of(400, ["s", "t", "u"], 5)
    for r in merkle.merkle_manifest(spark.createDataFrame(rows, DOCS), siblings=True).collect():
        node = r["leaf"]
        for step in r["proof"]:
            node = h(step["before"], node, step["after"])
        assert node == r["root"] == r["folded_root"] and r["verified"]
        assert r["proof_sha256"] == h(*(s["before"] + s["after"] for s in r["proof"]))
