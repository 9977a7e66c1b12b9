"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomframe.llm import ann, exact_dedup, hilbert, html_extract, licenses, mixing, packing, queries, simhash, toxicity, url_rules
from loomframe.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_id int, shard string, toxicity string, mix_key string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, long texts, clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(60000))
    rows = [
        (1, "one two three four five six", "en", "a", 1, 7, "x", "t", "k"),
        (1, "one two three four five six", "en", "a", 1, 7, "x", "t", "k"),
        (2, "one  two\tthree four\nfive six", None, "a", None, None, None, None, None),
        (None, "one two three four five six", "en", None, 1, 0, "", "", ""),
        (4, None, None, None, None, None, None, None, None),
        (5, "", "", "", 0, 0, "", "", ""),
        (6, " ", "", "", 0, 0, "", "", ""),
        (7, long, "en", "b", 1, 1, "s", "t", "k"),
        (8, long + " tail", "en", "b", 1, 1, "s", "t", "k"),
        (9, "Wörter mit Ümlaut — ok 漢字", "de", "b", 1, 1, "s", "t", "k"),
    ]
    return saved(spark, rows, DOCS)


def saved(spark, rows, schema):
    from loomframe.session import durable

    return durable(spark.createDataFrame(rows, schema), "test")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# 1 mixing


def test_mixing_rates_and_order(spark):
    docs = queries.table(spark, SF, "documents")
    got = mixing.mix(docs, {"src0": 0.5}, 2.0, 3)
    assert set(docs.columns) < set(got.columns)
    n = Counter((r.doc_id, r.mix_copy) for r in got.collect())
    assert set(n.values()) == {1}
    share = {r.source: r.b for r in got.groupBy("source").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    assert 0.35 < share["src0"] / sum(share.values()) < 0.65


def test_poisson_inverse():
    for rate in (0.05, 1.0, 7.5):
        total = term = math.exp(-rate)
        want = [total]
        for k in range(1, mixing.terms(rate)):
            term *= rate / k
            total += term
            want.append(total)
        assert want[-1] > 1 - 1e-12
        assert mixing.terms(rate) < 60


def test_mixing_small_source_reaches_its_share(spark):
    rows = [(i, "small", "x" * 100) for i in range(20)] + [(i, "large", "x" * 1000) for i in range(20, 1020)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert mixing.rates(docs, {"small": 0.2}, 1.0)["small"] > 5 * mixing.MAX_RATE
    got = mixing.mix(docs, {"small": 0.2}, 1.0, 3).select("doc_id", "source", "mix_copy", "mix_key", F.length("text").alias("n")).collect()
    share = sum(r.n for r in got if r.source == "small") / sum(r.n for r in got)
    assert 0.17 < share < 0.23
    copies = {}
    for r in got:
        copies.setdefault(r.doc_id, []).append(r.mix_copy)
    assert all(sorted(c) == list(range(len(c))) for c in copies.values())
    assert len({r.mix_key for r in got}) == len(got)
    # Poisson counts: their variance is their mean
    counts = [len(copies.get(i, [])) for i in range(20)]
    assert 0.3 < np.var(counts) / np.mean(counts) < 2.2
    one = spark.createDataFrame([(1, "small", "x"), (2, "large", "y" * 100000)], "doc_id long, source string, text string")
    n = Counter(r.doc_id for r in mixing.mix(one, {"small": 0.5}, 1.0, 3).select("doc_id").collect())
    assert 49000 < n[1] < 51000


def test_mixing_odd_rows(spark, odd):
    got = mixing.mix(odd, {"a": 0.5}, 3.0, 1)
    assert got.columns == [*odd.columns, "mix_copy", "_mix_key"]  # the input has a mix_key of its own
    by = Counter(r.mix_copy for r in got.where("doc_id = 1").collect())
    assert all(v == 2 for v in by.values())  # repeated rows draw alike
    assert mixing.mix(odd.where("false"), {"a": 0.5}).count() == 0
    # an absent source's share goes to the others
    with_absent, without = mixing.rates(odd, {"a": 0.4, "none": 0.2}, 2.0), mixing.rates(odd, {"a": 0.5}, 2.0)
    assert with_absent == pytest.approx(without)


# 2 packing


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing_round_trip(spark, odd):
    for docs in (odd.where("doc_id is not null and doc_id != 1"), queries.table(spark, SF, "documents")):
        texts = {r.doc_id: r.text for r in docs.collect()}
        want = dict(zip(texts, reference_ids(texts.values()), strict=True))
        got = packing.pack(docs, with_ids=True).collect()
        held = {d: [0] * len(x) for d, x in want.items()}
        assert len({r.sequence_id for r in got}) == len(got)
        for r in got:
            ids = want[r.doc_id][r.start : r.start + r.length]
            assert list(r.ids) == ids and r.offset == 0 and r.doc_tokens == len(want[r.doc_id])
            assert r.length <= 2048 and r.length & (r.length - 1) == 0 and r.length == 1 << r.bucket
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            for i in range(r.start, r.start + r.length):
                held[r.doc_id][i] += 1
        assert all(set(x) == {1} for x in held.values())


def test_packing_parts_and_empty(spark, odd):
    text = "It's a long text, with   spaces\n\nand numbers 123 456 and wörter " * 400
    assert "".join(packing.parts(text, 500)) == text and len(list(packing.parts(text, 500))) > 20
    want = reference_ids([text])[0][:-1]
    encoder = packing.Encoder.of(*packing.vocabulary())
    assert [i for p in packing.parts(text, 500) for i in encoder.ids(p)] == want
    runs = [" " * 9000, "\n" * 5000 + "x", "a" + " " * 5000 + "b <|endoftext|>", " " * 5000 + "<|endoftext|>\t" + "\u3000" * 4097 + " word", "é\x85" * 3000, "a" * 50000]
    assert [[*encoder.ids(x), 1] for x in runs] == reference_ids(runs)
    assert len(encoder.ids("x <|endoftext|> y")) == 4
    for long in (" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "ab" * 1_000_000):
        assert [*encoder.ids(long), 1] == reference_ids([long])[0]
    assert packing.pack(odd.where("false")).count() == 0
    assert rows_of(packing.pack(odd.where("doc_id in (4, 5)")), "doc_id", "length", "doc_tokens") == [(4, 1, 1), (5, 1, 1)]


# 3 toxicity


def brute_segments(s):
    """Maximal segments by recursion on the definition: the best, then left and right of it."""
    c = np.concatenate([[0], np.cumsum(s)])

    def best(lo, hi):
        top, where = 0, None
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                if c[b] - c[a] > top + 1e-9:
                    top, where = c[b] - c[a], (a, b)
        if where is None:
            return []
        return best(lo, where[0]) + [(*where, round(top, 6))] + best(where[1], hi)

    return best(0, len(s))


def test_segments_against_definition():
    rng = np.random.default_rng(1)
    for _ in range(150):
        s = rng.choice([0.41, 1.03, 3.77, -0.25, -0.25, -0.25, -0.25, -0.83, -2.1], int(rng.integers(1, 40)))
        got = [round(x, 5) for _, _, x in toxicity.maximal(s)]
        assert got == [round(x[2], 5) for x in brute_segments(s)]
    assert toxicity.maximal(np.array([])) == [] and toxicity.maximal(np.array([1.0, -2.0, 1.0])) == [(0, 1, 1.0), (2, 3, 1.0)]


def test_log_odds_and_calibration_by_hand():
    # counts 8 of 100 against 2 of 900, prior 5 % of both: (8.5 / 141.5) : (2.5 / 947.5)
    value, z = toxicity.log_odds(8, 2, 100, 900)
    assert value == pytest.approx(math.log(8.5 / 141.5) - math.log(2.5 / 947.5)) and z == pytest.approx(value / math.sqrt(1 / 8.5 + 1 / 2.5))
    rng = np.random.default_rng(3)
    counts = {2.0: 5, 0.7: 30, -0.4: 900, -1.5: 65}
    rate = toxicity.decay(counts)
    assert sum(n * math.exp(rate * s) for s, n in counts.items()) == pytest.approx(sum(counts.values()), rel=1e-9) and rate > 0
    assert toxicity.decay({}) == 1.0 and toxicity.decay({-1.0: 5}) == 1.0 and toxicity.decay({1.0: 5}) == 1.0
    # texts of ordinary words: about one in a hundred has a passage
    p = np.array(list(counts.values())) / sum(counts.values())
    seen = []
    for _ in range(4000):
        n = int(rng.integers(20, 200))
        seen.append((n, max((x for *_, x in toxicity.maximal(rng.choice(list(counts), n, p=p))), default=0.0)))
    k = toxicity.chance_factor(seen, rate)
    hit = sum(k * n * math.exp(-rate * s) <= toxicity.LEVEL for n, s in seen) / len(seen)
    assert 0.005 < hit < 0.02
    assert toxicity.ordinary_cost((40, 100), (95, 100)) == pytest.approx(math.log(96 / 102) - math.log(41 / 102))


def test_score_of_a_text_by_brute_force():
    """Every step of a document's score from the definitions."""
    model = toxicity.Model({"awful": 3.0, "terri*": 2.0, "kind": -1.5}, 0.4, 1.3, 0.5, (-3.0, 1.1, 0.7))
    rng = np.random.default_rng(4)
    for _ in range(40):
        words = rng.choice(["awful", "Terrible", "kind", "the", "cat", "42", "terrifying"], int(rng.integers(0, 30)), p=[0.1, 0.1, 0.1, 0.3, 0.2, 0.1, 0.1]).tolist()
        own = [{"awful": 3.0, "terrible": 2.0, "terrifying": 2.0, "kind": -1.5}.get(w.lower(), -0.4) for w in words if w != "42"]
        chance = [1.3 * s - math.log(0.5 * max(len(own), 1)) for _, _, s in brute_segments(own)]
        best, total = max([0.0, *chance]), sum(c for c in chance if c >= math.log(100))
        got = model.evidence(" ".join(words))
        assert got[0] == pytest.approx(best, abs=1e-4) and got[1] == pytest.approx(total, abs=1e-3)
        assert model.probability(best, total) == pytest.approx(1 / (1 + math.exp(3.0 - 1.1 * math.log1p(best) - 0.7 * math.log1p(total))))
    # tied segments count each; a very long text is read to its end
    assert len(model.evidence("awful " * 3 + "the " * 100 + "awful " * 3)[2]) == 2
    long = "the cat " * 200_000 + "awful " * 8
    assert model.evidence(long)[2][-1][1] == 400_008


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_toxic_segments(spark, sf)
    labels = queries.table(spark, sf, "labels").select("doc_id", "toxic")
    r = got.where("held_out").join(labels, "doc_id").collect()
    caught = [x.predicted for x in r if x.toxic == 1]
    wrong = [x.predicted for x in r if x.toxic == 0]
    assert sum(caught) / len(caught) > 0.75 and sum(wrong) / len(wrong) < 0.03
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in r)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model, passages=True, name="t2")
    assert got.count() == 10 and set(odd.columns) < set(got.columns)
    assert toxicity.fit(odd, labels.where("false")).curve is None
    assert toxicity.fit(odd.where("false"), labels).curve is None


# 4 url rules


def test_url_parts_and_rules(spark):
    rows = [
        (1, "https://WWW.Example.COM/en/70?x#y"), (2, "http://a.example.com/en/60"), (3, "http://example.net/de/8"), (4, "http://b.org/es/"),
        (5, None), (6, "no scheme"), (7, "x://"), (8, "http://excom/en/"), (9, "http://com/en/"), (10, "http://h?q=a/b#z://q"), (10, "http://h?q=a/b#z://q"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1), "row_id": F.lit(0)})
    none = spark.createDataFrame([], "rule_id string, antecedent array<string>, confidence double, support double")
    got = rows_of(url_rules.judge(pages, none), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([
        (1, "www.example.com", "/en/70", "example.com/en/7", "allow"), (2, "a.example.com", "/en/60", "com/en/", "block"), (3, "example.net", "/de/8", "example.net/de/8", "allow"),
        (4, "b.org", "/es/", "org/es/", "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "excom", "/en/", None, "allow"), (9, "com", "/en/", "com/en/", "block"), (10, "h", "", None, "allow"), (10, "h", "", None, "allow"),
    ], key=repr)


def test_url_mining(spark):
    bad = [(f"http://m.casino.test/x/{i}?q=1", True) for i in range(40)]
    good = [(f"https://news{i % 3}.test/a/{i}", i == 3) for i in range(60)]
    labelled = spark.createDataFrame(bad + good, "url string, blocked boolean")
    rules = url_rules.mine(labelled, min_support=0.05)
    found = {r.rule_id for r in rules.collect()}
    assert "h:casino" in found and "s:https" not in found
    pages = spark.createDataFrame([(1, "http://w.casino.test/z"), (2, "https://news1.test/a/9")], "page_id long, url string")
    assert rows_of(url_rules.judge(pages, rules), "page_id", "verdict") == [(1, "block"), (2, "allow")]
    assert url_rules.mine(labelled.where("false")).count() == 0


def test_url_rules_of_any_length(spark):
    """Three tokens that are only together a sign: each single and pair is as often allowed."""
    parts = [("casino", "news"), ("de", "en"), (".html", ".php")]
    rows = []
    for n in range(8):
        pick = [parts[i][n >> i & 1] for i in range(3)]
        rows += [(f"http://{pick[0]}.test/{pick[1]}/x{pick[2]}", n == 0)] * 10
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = saved_as(url_rules.mine(labelled, min_support=0.05))
    assert {tuple(r.antecedent) for r in rules.collect()} == {("e:.html", "h:casino", "p:de")}
    pages = spark.createDataFrame([(1, "https://casino.other/de/y.html"), (2, "https://casino.other/en/y.html")], "page_id long, url string")
    for most in (100, 0):
        assert rows_of(url_rules.judge(pages, rules, (), most), "page_id", "verdict") == [(1, "block"), (2, "allow")]


def test_url_rules_against_all_itemsets(spark):
    rng = np.random.default_rng(5)
    urls = ["http://" + ".".join(f"{c}" for c in "abcdefg" if rng.random() < 0.5) + "." + "z/" for _ in range(300)]
    rows = [(u, bool(rng.random() < (0.9 if "a" in u and "b" in u and "c" in u else 0.3))) for u in urls]
    sets = [(frozenset(r.t), b) for (_, b), r in zip(rows, spark.createDataFrame([(u,) for u in urls], "url string").select(url_rules.tokens(F.col("url")).alias("t")).collect(), strict=True)]
    every = sorted(set().union(*(t for t, _ in sets)))
    good = []
    for size in range(1, len(every) + 1):
        for c in combinations(every, size):
            hit = [b for t, b in sets if t >= set(c)]
            if sum(hit) >= math.ceil(0.02 * len(sets)) and sum(hit) / len(hit) >= 0.75 and not any(g < set(c) for g in good):
                good.append(set(c))
    assert max(map(len, good)) > 2
    got = url_rules.mine(saved(spark, rows, "url string, blocked boolean"), 0.02, 0.75)
    assert {frozenset(r.antecedent) for r in got.collect()} == {frozenset(g) for g in good}


def test_url_rules_need_several_urls_and_take_long_ones(spark):
    long = "http://h.test/" + "/".join(f"word{i}" for i in range(3000)) + "?q=" + "x" * 100_000
    rows = [(f"http://once{i}.test/a", True) for i in range(3)] + [(f"http://fine.test/{i}", False) for i in range(20)] + [(long, True)]
    rules = url_rules.mine(saved(spark, rows, "url string, blocked boolean"))
    assert rules.count() == 0  # no rule rests on a url or two
    # equally confident rules: the last by its name is named, and only rules better than the labels at large count
    rows = [("http://bad.test/x", True)] * 9 + [("http://fine.test/y", False)] * 9
    rules = url_rules.mine(saved(spark, rows, "url string, blocked boolean"))
    assert {r.rule_id for r in rules.collect()} == {"h:bad", "p:x"}
    pages = saved(spark, [(1, "http://bad.test/x"), (1, "http://bad.test/x"), (2, long), (3, long.replace("h.test", "bad.test"))], "page_id long, url string")
    got = rows_of(url_rules.judge(pages, rules, ()), "page_id", "verdict", "mined_rule")
    assert got == [(1, "block", "p:x"), (1, "block", "p:x"), (2, "allow", None), (3, "block", "h:bad")]


def test_url_rules_held_out(spark):
    """Rules mined on half of the labelled urls block the other half's mostly rightly."""
    labelled = saved_as(queries.labelled_urls(spark, "/root/testdata/sf0.1"))
    half = F.pmod(F.xxhash64("url"), F.lit(2)) == 0
    rules = url_rules.mine(saved_as(labelled.where(half)))
    rest = saved_as(labelled.where(~half).withColumn("page_id", F.monotonically_increasing_id()))
    got = url_rules.judge(rest, rules, ()).join(rest, "page_id").where("verdict = 'block'")
    blocked = [r.blocked for r in got.select("blocked").collect()]
    base = rest.agg(F.avg(F.col("blocked").cast("int")).alias("b")).first().b
    assert not blocked or sum(blocked) / len(blocked) > base


# 5 licenses


def brute_scan(text, scanner):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = {}
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.setdefault(label, []).append(i)
    found = {}
    name = {r: w.decode() for w, r in scanner.rank.items()}
    for label, order, need, width in scanner.templates:
        own = {name[r] for r in order}
        best = max((len(own & set(words[i : i + width])) for i in range(max(1, len(words)))), default=0)
        if best >= need:
            found[label] = max(found.get(label, 0), best / len(order))
    return len(words), places, found


def test_licenses_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = sorted({w for t in licenses.template_words() for w in t.split()}) + ["alpha", "beta", "ñu"]
    scanner = licenses.Scanner({w: int(rng.integers(0, 50)) for w in vocabulary})
    texts = ["", "MIT License mit license", "Apache  License gnu general public license"]
    for t in licenses.template_words():
        w = t.split()
        for drop in range(4):
            keep = [x for i, x in enumerate(w) if i not in set(rng.choice(len(w), min(drop, len(w)), replace=False))]
            noise = [str(rng.choice(vocabulary)) for _ in range(int(rng.integers(0, 30)))]
            at = int(rng.integers(0, len(noise) + 1))
            texts.append(" ".join(noise[:at] + keep + noise[at:]))
    texts += [" ".join(rng.choice(vocabulary, 60)) for _ in range(60)]
    for text in texts:
        words = licenses.words_of(text.encode())
        n, places, found = brute_scan(text, scanner)
        assert len(words) == n and scanner.places(words) == places
        assert scanner.matches(words) == pytest.approx(found)
    assert scanner.followed < scanner.hits


def test_license_places_prune():
    """A rare word among words that rank before it is not followed up; among enough that rank after it, it is."""
    scanner = licenses.Scanner({w: i for i, w in enumerate("a b c d e f g h i j".split())}, {"a b c d e": "x", "f g h i j": "y"})
    cases = {"b a a b": 0, "f a b c d e": 2, "a b c d": 2, "g a b c h": 2, "f": 0, "f g h i": 2}
    for text, least in cases.items():
        scanner.hits = scanner.followed = 0
        words = text.encode().split()
        _, _, found = brute_scan(text, scanner)
        assert scanner.matches(words) == pytest.approx(found)
        assert scanner.followed >= (least if found else 0)
    scanner.hits = scanner.followed = 0
    scanner.matches(b"f g a b c".split())
    # y: only f and g are there and nothing ranks after them; x: all of c, d and e could still follow a, b
    assert scanner.hits == 4 and scanner.followed == 2


def test_licenses_odd_rows(spark, odd):
    got = licenses.scan(odd.withColumn("labels", F.lit("clash")))
    assert got.count() == 10 and got.where("score != 0").count() == 0
    assert licenses.scan(odd.where("false")).count() == 0


# 6 nearest neighbours


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:160] = x[5]
    rows = [(i, x[i].tolist(), 0) for i in range(3000)]
    rows += [(5001, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (5300, [1.0] * 3, 0), (5400, [None] * 16, 0), (None, x[0].tolist(), 0)]
    got = ann.nearest(saved(spark, rows, "vec_id long, embedding array<float>, rank int"), F.col("vec_id") % 50 == 0, k=10, row_block=700, query_block=16).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 50))
    hit = 0
    for q, found in by.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(f[2] == pytest.approx(d[f[1]], abs=1e-12) for f in found)
        hit += len({f[1] for f in found} & set(want.tolist()))
        if 100 <= q < 160:
            assert [f[1] for f in found] == [5, *[i for i in range(100, 112) if i != q]][:10]
    assert hit / (10 * len(by)) >= 0.9
    few = saved(spark, rows[:3], "vec_id long, embedding array<float>, rank int")
    assert rows_of(ann.nearest(few, F.col("vec_id") == 0), "query_id", "rank")[-1] == (0, 2)
    assert ann.nearest(few.where("false"), F.lit(True)).count() == 0


def test_anisotropic_codes_lose_less_parallel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 12))
    parallel = {}
    for eta in (1.0, 8.0):
        book = ann.Codebook.fit(x, rounds=4)
        book.eta = eta
        r = ann.Codebook.split(x) - book.decode(book.code(x))
        u = ann.Codebook.split(x) / np.linalg.norm(x, axis=1)[:, None, None]
        parallel[eta] = np.abs(np.einsum("nmd,nmd->n", u, r)).mean()
    assert parallel[8.0] < parallel[1.0]


# 7 html


def test_html_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad banner">Buy now</div><div id=cookie-notice>We use cookies</div>
    <article><h1>Head &amp; line</h1><p>First  paragraph &lt;b&gt; with <b>bold</b> text &#233;.<p>Second<br>one.</p><aside>Related things</aside><p>Third.</p></article>
    <section class="comments"><p>I disagree with all of this at length and more.</p></section><form><input value=x><label>Mail</label></form><footer>&copy; x</footer></body></html>"""
    assert html_extract.main_text(page) == "Head & line First paragraph <b> with bold text é. Second one. Third."
    plain = "<div class=sidebar><p>Menu things</p></div><div><p>" + "Body text here. " * 20 + "</p><p>Last words.</p></div><div class=footer>F</div>"
    assert html_extract.main_text(plain) == ("Body text here. " * 20).strip() + " Last words."
    assert html_extract.main_text("") == "" and html_extract.main_text("<p>cut <b>off <a hre") == "cut off"


@pytest.mark.parametrize("page, want", [
    ("<div class='content has-sidebar'><p>Some text of the page.</p></div>", "Some text of the page."),
    ("<div class='sidebar'><p>All there is.</p></div>", "All there is."),
    ("<article><div class='entry-header'><h1>Head</h1></div><p>Body of it.</p><div class='share-bar'>Share this</div></article>", "Head Body of it."),
    ("<main><p>One.</p><div role=alert>Notice!</div><p>Two.</p></main><div id='reader-comments'><p>No.</p></div>", "One. Two."),
    ("<ARTICLE><P>Upper &quot;case&quot;&nbsp;tags<BR/>too</P></ARTICLE><noscript>x</noscript>", 'Upper "case" tags too'),
    ("<article><p>a < b and c > d</p><pre>  x   y\n z </pre><table><tr><td>1</td><td>2</td></tr></table></article>", "a < b and c > d x y z 1 2"),
])
def test_html_variants(page, want):
    assert html_extract.main_text(page) == want


def test_html_surge_decides_over_article_elements():
    body = " ".join(f"Sentence {i} of the story." for i in range(12))
    card = "<article><h2><a href=/x>Teaser</a></h2><p>Short blurb.</p></article>"
    page = f"<div><p>{body}</p><p>{body}</p><p>{body}</p></div><div>{card}{card}</div>"
    assert html_extract.main_text(page) == " ".join([body] * 3)
    # links at an article's end are its text, also where several follow each other
    links = "".join(f"<p><a href=/{i}>Source {i}</a></p>" for i in range(5))
    page = f"<nav><a href=/>Home</a></nav><article><p>{body}</p>{links}</article><div><p>Other words.</p></div>"
    assert html_extract.main_text(page) == " ".join([body, *(f"Source {i}" for i in range(5))])
    # long text beside an article is not lost for being outside
    page = f"<article><p>{body}</p><p>{body}</p></article><div><p>{body}</p><p>{body}</p></div>"
    assert html_extract.main_text(page) == " ".join([body] * 4)
    # empty lines between tags do not end a run, lines of links before it are not in it
    page = f"<ul><li><a href=\"/home\">Home</a></li></ul><div><div><p>{body}</p></div></div><div><div></div></div><div><div><p>End.</p></div></div>"
    assert html_extract.main_text(page) == body + " End."


def brute_runs(weights, window=3):
    """Surge and dive by definition: runs of lines whose windows hold weight, from a line of weight on."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    out, i = [], 0
    while i < len(weights):
        if sums[i] and weights[i]:
            j = i
            while j < len(weights) and sums[j]:
                j += 1
            out.append((i, j, max(sums[i:j])))
            i = j
        else:
            i += 1
    return out


def test_html_unmarked_pages_against_surge_and_dive():
    """Pages of bare divs: only the lengths of their lines and links say what is text."""
    rng = np.random.default_rng(12)
    chosen = 0
    for _ in range(400):
        rows = []
        for _ in range(int(rng.integers(1, 25))):
            n = int(rng.choice([0, 0, 3, 20, 150]))
            linked = int(rng.choice([0, 0, 1, 5]))
            rows.append((" ".join(f"t{rng.integers(9)}" for _ in range(n)), " ".join(f"l{rng.integers(9)}" for _ in range(linked))))
        page = "".join(f"<div>{t} <a href=x>{k}</a></div>" if k else f"<div>{t}</div>" for t, k in rows)
        rows = [(f"{t} {k}".strip(), len(t) + 1 if t and k else len(t)) for t, k in rows if t or k]
        found = brute_runs([w for _, w in rows])
        top = max((p for *_, p in found), default=0)
        want = " ".join(s for a, b, p in found if p >= html_extract.SURGE * top for s, _ in rows[a:b])
        assert html_extract.main_text(page) == want
        chosen += want != " ".join(s for s, _ in rows)
    assert chosen > 100  # leaving out the choice of runs would change these pages


def test_html_class_words_do_not_delete_dense_text():
    body = "A paragraph of the article that is long enough to be read as text by anyone. " * 3
    for mark in ("id=discussion", "class=response", 'class="legal"', "class=feedback"):
        page = f"<article><p>{body}</p><section {mark}><p>{body}</p><p>{body}</p></section><div {mark}>Short</div><p>End.</p></article>"
        text = html_extract.main_text(page)
        assert text == " ".join([body.strip()] * 3 + ["End."]) or text == " ".join([body.strip()] * 3 + ["Short", "End."])
        assert html_extract.main_text(f"<article><p>{body}</p><div {mark}>Short</div><p>End.</p></article>") == body.strip() + " End."
        assert html_extract.main_text(f"<article><p>{body}</p></article><section {mark}><p>{body}</p></section>") == body.strip()
    assert html_extract.main_text(f"<article><p>{body}</p><section class=comments><p>{body}</p></section></article>") == body.strip()
    assert html_extract.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>") == "So x=1 holds."


def test_html_odd_rows(spark):
    rows = [(1, None, None, 3), (1, "u", "", 3), (None, "u", "<article><p>x</p></article>", 3), (2, "u", "<p>" + "long text " * 50000, 3)]
    got = {(r.page_id, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert got == {(1, 0), (None, 1), (2, 499999)}


# 8 exact dedup


def test_fingerprint_composes():
    rng = np.random.default_rng(4)
    for n in (0, 1, 17, 4095, 4096, 4097, 9000, 300000):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        whole = exact_dedup.fingerprint(data)
        h = [0, 0]
        for b in data[-2000:] if n <= 2000 else b"":
            h = [(x * base + b) % p for x, base, p in zip(h, exact_dedup.BASES, exact_dedup.PRIMES, strict=True)]
        if n <= 2000:
            assert tuple(h) == whole
        for cut in (0, n // 3, n):
            assert exact_dedup.combine(exact_dedup.fingerprint(data[:cut]), exact_dedup.fingerprint(data[cut:]), n - cut) == whole


def test_exact_groups(spark, odd):
    got = exact_dedup.mark(odd, huge=1000, chunk=4096)
    want = {}
    for r in odd.collect():
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        want.setdefault(text, []).append(r.doc_id)
    out = []
    for text, ids in want.items():
        ids = sorted(ids, key=lambda d: (d is None, d))
        for i, d in enumerate(ids):
            out.append((d, ids[0], len(ids), i == 0, hashlib.sha256(text.encode()).hexdigest()))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(out, key=repr)
    assert rows_of(exact_dedup.mark(odd), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(out, key=repr)
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(want)
    assert exact_dedup.mark(odd.where("false")).count() == 0


def test_collisions_are_split(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb", "bb"])]
    docs = saved(spark, rows, "doc_id long, text string")
    keys = exact_dedup.digests(docs).withColumns({"fp_a": F.lit(0).cast("long"), "fp_b": F.lit(0).cast("long")}).drop("text_sha256")
    from loomframe.session import durable

    keys = durable(keys, "collide")
    ids = {r.row_id: r.doc_id for r in keys.collect()}
    got = {(ids[r.row_id], ids[r.group_id]) for r in exact_dedup.equal_groups(docs, keys).collect()}
    assert got == {(2, 0), (4, 1), (5, 1)}


# 9 simhash


def brute_print(text, k=4):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_stay(texts, least=0.8):
    """Ids that stay when documents are taken in order and go if similar to one that stays; pairs share a shingle."""
    sets, held, stay = {d: shingle_set(t) for d, t in texts.items()}, {}, []
    for d in sorted(sets):
        near = {x for g in sets[d] for x in held.get(g, ())} if sets[d] else {x for x in stay if not sets[x]}
        if any(alike(sets[d], sets[x]) >= least for x in near):
            continue
        stay.append(d)
        for g in sets[d]:
            held.setdefault(g, []).append(d)
    return set(stay)


def brute_groups(prints, radius):
    """Smallest id reachable for each id."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    want = brute_groups(prints, 4)
    got = queries.op9_simhash_groups(spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{prints[d]:016x}", want[d]) for d in prints}


@pytest.mark.parametrize("limit", [4096, 30])
def test_links_of_dense_prints(spark, limit):
    rng = np.random.default_rng(6)
    values = set()
    for c in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        for _ in range(25):
            v = c
            for b in rng.integers(0, 64, int(rng.integers(0, 9))).tolist():
                v ^= 1 << b
            values.add(v)
    ids = {i: v for i, v in enumerate(sorted(values))}
    back = {v: i for i, v in ids.items()}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = spark.createDataFrame([(signed(v), signed(v)) for v in values], "node long, p0 long")
    for radius in (0, 4, 6):
        links = simhash.links(prints, lambda p: simhash.exact_shards(p, radius), radius, limit)  # noqa: B023
        roots = {r.node: r.root for r in components(links).collect()}
        want = brute_groups(ids, radius)
        label = {}
        for v in values:
            label.setdefault(roots.get(signed(v), signed(v)), []).append(back[v])
        got = {i: min(g) for g in label.values() for i in g}
        assert got == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (900, 900)], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_simhash_odd_rows(spark, odd):
    got = simhash.mark(odd).collect()
    assert len(got) == 10
    assert {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, 4, 7, 9}
    assert simhash.mark(odd.where("false")).count() == 0


def test_near_copies_against_brute_force(spark):
    """Every pair with a common shingle counts in the brute force."""
    sf = "/root/testdata/sf0.1"
    docs = exact_dedup.deduplicate(queries.table(spark, sf, "documents"))
    docs = saved_as(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute_stay(texts)
    got = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    gone, dropped = set(texts) - want, set(texts) - got
    assert len(gone) > 30
    assert len(gone & dropped) >= 0.95 * len(gone) and len(dropped - gone) <= 0.05 * len(dropped)


@pytest.mark.parametrize("leaders, per_salt", [(8, 512), (1, 3)])
def test_copies_are_settled_in_order(spark, leaders, per_salt):
    """One group of a hundred texts with chains of similarity: the result is that of one pass in order."""
    rng = np.random.default_rng(8)
    texts, base = {}, None
    for d in range(100):
        if d % 9 == 0:
            base = [f"w{x}" for x in rng.integers(0, 500, 120)]
        else:
            base = list(base)
            for _ in range(int(rng.integers(0, 4))):
                base[int(rng.integers(0, 120))] = f"v{rng.integers(0, 500)}"
        texts[d] = " ".join(base)
    texts |= {100: "", 101: None, 102: "a b"}
    docs = saved(spark, [(int(d), t) for d, t in texts.items()], "doc_id long, text string")
    grouped = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.lit(0).cast("long").alias("root"))
    ids = {r.row_id: r.doc_id for r in grouped.collect()}
    gone = {ids[r.row_id] for r in simhash.copies(docs, grouped, leaders=leaders, per_salt=per_salt).collect()}
    assert set(texts) - gone == brute_stay(texts)


def test_bands_cover_the_words():
    rng = np.random.default_rng(9)
    words = rng.integers(0, 2**63, (5, 8), dtype=np.uint64)
    whole = [sum(int(w) << 64 * i for i, w in enumerate(row)) for row in words]
    assert simhash.bands(8, 20)[-1][0] == 7 and len(simhash.bands(8, 20)) == 25
    for k, (at, shift, size) in enumerate(simhash.bands(8, 20)):
        assert 64 * at + shift == 20 * k and size == 20
        assert [(w >> 20 * k) & (2**20 - 1) for w in whole] == [((int(r[at]) >> shift) | (int(r[at + 1]) << 64 - shift if shift + size > 64 else 0)) & (2**20 - 1) for r in words]


# 10 sharding


def test_hilbert_index_is_a_curve():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        axes = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        h = hilbert.hilbert_index(axes, bits)
        assert sorted(h.tolist()) == list(range(1 << bits * dims))
        path = axes[np.argsort(h)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards_obey_the_law(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_hilbert_shards(spark, sf).toPandas()
    docs = queries.table(spark, sf, "documents").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs)
    assert (both["size"] == both["text"].fillna("").map(lambda t: len(t.encode())) + 16).all()
    assert (both["text_crc32"] == both["text"].fillna("").map(lambda t: zlib.crc32(t.encode()))).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    by = got.groupby("shard")["size"].sum()
    assert set(by.index) <= set(range(40)) and (by - got["size"].sum() / 40).abs().max() <= got["size"].max()


def test_shards_follow_the_curve_and_keep_groups(spark):
    sf = "/root/testdata/sf0.1"
    docs = queries.table(spark, sf, "documents")
    got = hilbert.shard(docs).toPandas().sort_values(["shard", "slot"])
    assert (np.diff(got["hilbert"]) >= 0).all()
    by = got.groupby("shard")["size"].sum()
    limit = max(hilbert.SLACK * got["size"].sum() / 40, got["size"].max())
    assert (by - got["size"].sum() / 40).abs().max() <= limit
    text = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("m")).toPandas()
    both = got.merge(text, on="doc_id").groupby("m").agg(b=("size", "sum"), shards=("shard", "nunique"), n=("size", "size"))
    assert (both[both["n"] > 1]["b"] <= limit).any() and (both[both["b"] <= limit]["shards"] == 1).all()


def test_shards_of_a_hot_group_and_a_long_text(spark, tmp_path):
    rows = [(i, "same text " * 20, "en", "a") for i in range(600)] + [(i, f"text {i} " * 20, "de", "b") for i in range(600, 1200)] + [(1200, "long " * 200_000, "fr", "c")]
    docs = saved(spark, rows, "doc_id long, text string, lang string, source string")
    got = hilbert.shard(docs, shards=4).toPandas()
    assert sorted(got["doc_id"]) == list(range(1201))
    by = got.groupby("shard")["size"].sum()
    assert by.max() >= 1_000_000 and got[got["doc_id"] == 1200]["shard"].nunique() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    small = docs.where("doc_id < 1200")
    placed = saved_as(hilbert.shard(small, shards=4))
    by = placed.groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert by.max() - by.min() <= 2 * max(hilbert.SLACK * by.sum() / 4, 400)  # the hot group is cut where a shard ends
    hilbert.write(small, placed, str(tmp_path / "out"), rows_per_task=50)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1200


def test_shards_prune_and_odd_rows(spark, odd, tmp_path):
    sf = "/root/testdata/sf0.1"
    docs = queries.table(spark, sf, "documents")
    spread = hilbert.ranges(docs, hilbert.shard(docs), ["source", "lang", "doc_id"])
    touched = spread.where("min_lang <= 'fr' and max_lang >= 'fr'").count()
    assert touched < 40
    placed = hilbert.shard(odd, shards=3)
    assert placed.count() == 10 and placed.where("size is null or shard is null").count() == 0
    assert hilbert.shard(odd.where("false")).count() == 0
    unique = odd.where("doc_id > 3")
    hilbert.write(unique, hilbert.shard(unique, shards=2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == unique.count()


# pipeline


def test_pipeline_against_stage_by_stage(spark):
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, queries.table(spark, SF, "labels"))
    clean = {d for d, r in rows.items() if model.probability(*model.evidence(r.text or "")[:2]) < queries.TOXIC}
    first = {}
    for d in sorted(clean):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[d].text or ""), d)
    kept = brute_stay({d: rows[d].text for d in first.values()})
    stages = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = saved_as(stage(spark, now, SF))
        stages[name] = now
    assert {r.doc_id for r in stages["toxicity"].collect()} == clean
    assert {r.doc_id for r in stages["exact dedup"].collect()} == set(first.values())
    assert {r.doc_id for r in stages["near dedup"].collect()} == kept
    assert all(stages[n].columns == docs.columns for n in list(stages)[:-1])
    mixed = Counter(r.doc_id for r in stages["mixing"].collect())
    assert set(mixed) <= kept
    tokens = Counter()
    for r in stages["packing"].collect():
        tokens[r.doc_id] += r.length
    want = {d: len(reference_ids([rows[d].text])[0]) * n for d, n in mixed.items()}
    assert tokens == want


def test_pipeline_stages_on_odd_rows(spark, odd):
    """Nulls, repeated rows, clashing names and an empty table go through every stage."""
    import corpus_pipeline

    now, empty = odd, saved_as(odd.where("false"))
    for name, stage in corpus_pipeline.STAGES:
        now, empty = saved_as(stage(spark, now, SF)), saved_as(stage(spark, empty, SF))
        assert empty.count() == 0
        if name != "packing":
            assert now.columns == odd.columns and empty.columns == odd.columns
        if name == "exact dedup":
            assert {r.doc_id for r in now.collect()} == {1, 4, 6, 7, 8, 9}
        if name == "near dedup":
            # the long text's longer copy goes; all texts without words count as alike
            assert {r.doc_id for r in now.collect()} == {1, 4, 7, 9}
    assert {r.doc_id for r in now.collect()} <= {1, 4, 7, 9} and all(r.length & (r.length - 1) == 0 for r in now.collect())


def saved_as(df):
    from loomframe.session import durable

    return durable(df, "stage")
