"""Each operator against a plain version of its contract, on documents with every edge case."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_extraction, language_id, line_dedup, lm_scoring, mixing, near_dedup, quality_rules, secret_scan, substring_dedup
from tidemark.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
bag = lambda rows: Counter(map(repr, rows))


def test_substring_dedup(stored, rows, none):
    starts = defaultdict(lambda: math.inf)
    for r in rows:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - 49):
            if r[0] is not None:
                starts[tuple(w[i : i + 50])] = min(starts[tuple(w[i : i + 50])], r[0])
    want = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = set()
        for i in range(len(w) - 49):
            if r[0] is not None and starts[tuple(w[i : i + 50])] < r[0]:
                gone.update(range(i, i + 50))
        want.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    out = substring_dedup.remove_repeats(stored).select("doc_id", "n_words", "n_removed", "kept_text", "removed").collect()
    assert bag(tuple(r)[:4] for r in out) == bag(want)
    assert sum(w[2] for w in want) > 300
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in out)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_repeats_of_rows_that_share_an_id(spark):
    """One earlier document and two rows of one id with a passage, in as many shards as there are pairs of rows."""
    draw = random.Random(4)
    sentence = lambda n: " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(5000)}" for _ in range(n))
    rows = []
    for g in range(40):
        passage = sentence(70)
        rows += [(3 * g, f"{sentence(9)} {passage}"), (3 * g + 1, f"{passage} {sentence(12)}"), (3 * g + 1, f"{sentence(5)} {passage} {sentence(20)}")]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), docs_per_shard=2).collect()
    assert bag((r["doc_id"], r["n_words"], r["n_removed"]) for r in out) == bag((i, len(t.split()), 70 * (i % 3)) for i, t in rows)


@pytest.mark.parametrize("docs_per_shard", [2, 7])
def test_shards_change_nothing(stored, docs_per_shard):
    columns = ["doc_id", "n_words", "n_removed", "kept_text"]
    out = substring_dedup.remove_repeats(stored, docs_per_shard=docs_per_shard).select(columns).collect()
    assert bag(map(tuple, out)) == bag(map(tuple, substring_dedup.remove_repeats(stored).select(columns).collect()))


def test_near_duplicates(stored, rows, none):
    sets = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        if w:
            sets[r[1]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])
    root = {t: t for t in sets}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in sets:
        for b in sets:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: math.inf)
    for r in rows:
        if r[1] in sets and r[0] is not None:
            least[find(r[1])] = min(least[find(r[1])], r[0])
    want = [(r[0], least[find(r[1])] if r[1] in sets else r[0]) for r in rows]
    out = near_dedup.near_duplicates(stored).collect()
    assert bag((r["doc_id"], r["class_id"]) for r in out) == bag(want)
    assert len({w[1] for w in want}) < len({w[0] for w in want}) - 8
    firsts = Counter(r["class_id"] for r in out if r["is_first"])
    assert all(n == 1 for c, n in firsts.items() if c not in (None, 7))  # two texts have the id 7
    assert near_dedup.near_duplicates(none).count() == 0


def test_signatures_estimate_probability_jaccard():
    shingles = np.arange(300, dtype=np.uint64) * np.uint64(7919)
    a, b = shingles[:250], shingles[50:]
    row = np.repeat([0, 1, 2], [250, 250, 250])
    kept = near_dedup.signatures(row, np.concatenate([a, b, a]), np.ones(750, int), 3)
    assert (kept[0] == kept[2]).all()
    assert abs((kept[0] == kept[1]).mean() - 200 / 300) < 0.12
    weighted = near_dedup.signatures(np.repeat([0, 1], 250), np.concatenate([a, a]), np.concatenate([np.ones(250, int), np.full(250, 9)]), 2)
    assert (weighted[0] == weighted[1]).all()  # one factor for all weights changes nothing


@pytest.mark.parametrize("min_sites", [2, 5, 10])
def test_line_dedup(docs, rows, none, min_sites):
    sites = defaultdict(set)
    lines = lambda t: t.split("\n") if t is not None else []
    for r in rows:
        for line in lines(r[1]):
            sites[line.strip(" \t\r\v\f")].add(r[3])
    gone = {k for k, v in sites.items() if k and len(v) >= min_sites}
    want = []
    for r in rows:
        kept = [x for x in lines(r[1]) if x.strip(" \t\r\v\f") not in gone]
        want.append((r[0], None if r[1] is None else "\n".join(kept), len(lines(r[1])), len(lines(r[1])) - len(kept)))
    out = line_dedup.remove_boilerplate(docs, min_sites)
    assert bag(map(tuple, out.select("doc_id", "text", "n_lines", "n_removed").collect())) == bag(want)
    assert set(docs.columns) <= set(out.columns)
    assert line_dedup.remove_boilerplate(none, min_sites).count() == 0


def benchmark(spark, rows):
    passage = rows[33][1].split()[-80:]
    items = [(1, " ".join(passage[5:40]).upper()), (2, " ".join(passage[20:33])), (10, "one two"), (3, None), (4, "!!"), (None, " ".join(passage[60:75])), (2, "three")]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("bits", [28, 16])
def test_decontamination(stored, rows, none, bits, monkeypatch):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: word.findall((t or "").translate(low))
    items = benchmark(stored.sparkSession, rows)
    windows = defaultdict(set)
    for i, t in map(tuple, items.collect()):
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].update([] if i is None else [str(i)])
    want = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.append((r[0], len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    out = decontaminate.digest(decontaminate.overlaps(stored, items, keep=["doc_id"]))
    assert bag(map(tuple, out.collect())) == bag(want)
    assert sum(w[5] for w in want) >= 3
    whole = decontaminate.overlaps(stored, items)
    assert {"n_hit", "items"} <= set(whole.columns) and {c for c in stored.columns if c not in ("n_words", "spans")} <= set(whole.columns)
    assert decontaminate.overlaps(none, items).count() == 0
    assert decontaminate.digest(decontaminate.overlaps(stored, items.where("false"))).where("contaminated OR n_hit > 0").count() == 0


def test_secret_scan(stored, rows, none):
    kinds = [("assign", secret_scan.PATTERNS["assign"], lambda m: len(m[2]) >= 6), ("access", secret_scan.PATTERNS["access"], lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    want = []
    for r in rows:
        spans = sorted((m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, r[1] or "") if ok(m))
        want.append((r[0], *(sum(s[1] == k for s in spans) for k in range(3)), sha(",".join(s[2] for s in spans))))
    out = secret_scan.digest(secret_scan.scan(stored)).collect()
    assert bag(tuple(r)[:5] for r in out) == bag(want)
    assert sum(sum(w[1:4]) for w in want) >= 4
    assert any("opaque:0:25" in r["spans"] for r in out)
    assert secret_scan.scan(none).count() == 0


def test_copied_secrets_are_not_added(spark):
    """The shared value has the shape and the entropy of a live one; only its owners tell."""
    live, shared = "Zx9Kq0LmN8pQr7StU6vWx5Yz4", "Ab3Bc4Cd5De6Ef7Fg8Gh9Hi0Ij1"
    docs = spark.createDataFrame([(1, live, "s1"), *((i, f"see {shared}", f"s{i}") for i in range(2, 8))], "doc_id long, text string, source string")
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.digest(secret_scan.scan(docs)).collect()}
    assert spans == {1: "opaque:0:25"} | dict.fromkeys(range(2, 8), "")


def test_quality_statistics(stored, rows, none):
    want = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice), len(w) < 50 or 100 * len(twice) > 50 * len(w)))
    labels = stored.sparkSession.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = quality_rules.judge(stored, labels)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert bag(map(tuple, out.select(*columns).collect())) == bag(want)
    assert out.where("kept = base_failed").count() == 0  # too few labels to certify a rule
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(stored, labels.where("false")).where("kept = base_failed").count() == 0


def test_exact_binomial_thresholds():
    assert quality_rules.binomial_tail(0, 10, 0.1) == pytest.approx(0.9**10)
    assert quality_rules.binomial_tail(2, 5, 0.5) == pytest.approx(0.5)
    level, bad = np.array([1.0, 0.0, 0.001, 0.005]), np.array([0, 50, 50, 50])
    pick = lambda good: quality_rules.choose(level, np.array(good), bad, alpha=0.01, error=0.01, lift=3.0)
    assert pick([5000, 0, 0, 0]) == 0.005
    assert pick([5000, 0, 100, 0]) == 0.0  # beyond it 2 % are rejected
    assert pick([5000, 100, 0, 0]) is None and pick([300, 0, 0, 0]) is None  # too few labels for this risk
    assert quality_rules.choose(level, np.array([5000, 0, 0, 0]), np.array([9, 50, 0, 0]), 0.01, 0.01, 3.0) == 0.0  # no bad ones for more strictness


def junk_and_text(spark, strata):
    clean = "plain words of a usual text that go on and differ " + " ".join(f"w{i}" for i in range(60))
    junk = " ".join(f"w{i}###" for i in range(70))
    rows = [(i, junk if i % 4 == 1 else f"{clean} n{i}", strata(i)) for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_rules_reject_within_the_risk(spark):
    docs = junk_and_text(spark, lambda i: "en")
    labels = docs.where("doc_id % 3 > 0").select("doc_id", F.when(F.col("doc_id") % 4 == 1, 0).otherwise(1).alias("quality"))
    out = quality_rules.judge(docs, labels)
    assert out.where("doc_id % 4 <> 1 AND NOT kept").count() == 0
    assert out.where("doc_id % 4 = 1 AND kept").count() == 0
    assert {tuple(r[0]) for r in out.where("NOT kept").select("rejected_by").distinct().collect()} == {("symbols",)}


def test_small_strata_are_pooled(spark):
    docs = junk_and_text(spark, lambda i: None if i % 40 < 2 else f"l{i % 20}")
    labels = docs.where("lang <> 'l5' OR lang IS NULL").select("doc_id", F.when(F.col("doc_id") % 4 == 1, 0).otherwise(1).alias("quality"))
    stats = quality_rules.statistics(docs).cache()
    (pool,) = quality_rules.certified(stats, labels).collect()
    assert pool["stratum"] == quality_rules.POOL and pool["threshold"] <= 0 and pool["k_bad"] == pool["n_bad"] > 100 and pool["k_good"] == 0
    out = quality_rules.judge(docs, labels)
    assert out.where("kept = (doc_id % 4 = 1)").count() == 0  # the stratum without labels too
    few = quality_rules.judge(docs, labels.where("doc_id < 200"))
    assert few.where("NOT kept").count() == 0


def test_quality_rules_decide_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_rules.judge(docs, labels).join(labels, "doc_id").where("NOT base_failed").select("kept", "quality", "doc_id")
    bad, good = out.where("quality = 0"), out.where("quality = 1")
    assert bad.where("NOT kept").count() >= 0.8 * bad.count() > 0
    assert good.where("NOT kept").count() <= quality_rules.ALPHA * good.count()


def test_mixing(stored, rows, none):
    out = [tuple(r) for r in mixing.fair_queue(stored).select("doc_id", "source", "size", "source_size", "target", "taken").collect()]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit >= 3 * sizes[s]}
        if not full:
            target |= {s: weight[s] * unit for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        free -= full
    assert bag(r[:4] for r in out) == bag((r[0], r[3], len(WORD.findall(r[1] or "")), sizes[r[3]]) for r in rows)
    taken = Counter()
    for _, source, size, _, goal, n in out:
        assert goal == pytest.approx(target[source]) and n <= 3 * size
        taken[source] += n
    assert sum(taken.values()) == sum(sizes.values())
    assert all(abs(taken[s] - target[s]) <= len(order) for s in order)
    again = mixing.fair_queue(stored.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert bag(map(tuple, again)) == bag(out)
    assert mixing.fair_queue(none).count() == 0


def test_language_id(spark, none, rows, stored):
    one, two = [f"the {a} and {b} of {c}" for a in ("house", "garden", "water") for b in ("stone", "wind") for c in ("morning", "light")], [f"der {a} und {b} von {c}" for a in ("Haus", "Garten", "Wasser") for b in ("Stein", "Wind") for c in ("Morgen", "Licht")]
    labelled = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in one] + [(t, "de") for t in two])] + [(None, "x", "en"), (99, None, "de"), (98, "qqq", None)], "doc_id long, text string, lang string")
    filters = language_id.learn(labelled)
    asked = spark.createDataFrame([(1, "the wind of the garden"), (2, "der Wind und das Licht"), (3, None), (4, "12 !!"), (5, ""), (6, "жжж"), (1, "the wind of the garden")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(asked, filters).collect()}
    assert (got[1][0], got[2][0], got[3], got[4], got[5]) == ("en", "de", ("und", 0.0), ("und", 0.0), ("und", 0.0))
    assert got[6] == (filters.languages[0], 0.0) and all(0 <= s <= 1 for _, s in got.values())
    nothing = language_id.learn(none)
    assert {r["lang_pred"] for r in language_id.identify(asked, nothing).collect()} == {"und"}
    out = language_id.identify(stored, filters)
    assert out.count() == len(rows) and out.columns == [*(c for c in stored.columns if c != "score"), "lang_pred", "score"]
    assert language_id.identify(none, filters).count() == 0


def test_filters_return_all_languages_of_an_ngram():
    grams = [np.arange(100 * k, 100 * k + 150, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in range(70)]  # over 64 languages
    filters = language_id.Filters.build([str(k) for k in range(70)], grams)
    for k, g in enumerate(grams):
        found = np.ones(len(g), np.uint64) * np.uint64(2**64 - 1)
        for at in filters.places(g):
            found &= filters.masks[k // 64, at]
        assert ((found >> np.uint64(k % 64)) & np.uint64(1)).all()


def plain_language(text: str | None, filters: language_id.Filters) -> tuple[str, float]:
    """One prediction, letter by letter and language by language."""
    low, mask = (text or "").lower(), (1 << 64) - 1
    letter = lambda i: ord(low[i]) if 0 <= i < len(low) and low[i].isalpha() else 0
    hits, n = [0] * len(filters.languages), 0
    for i in range(len(low)):
        if not letter(i):
            continue
        h = (letter(i - 1) * 0x9E3779B97F4A7C15 & mask) ^ (letter(i) * 0xC2B2AE3D27D4EB4F & mask) ^ (letter(i + 1) * 0x165667B19E3779F9 & mask)
        h = int(W.mix(np.array([h], np.uint64))[0])
        places = [(h >> 20 * j) & (language_id.SLOTS - 1) for j in range(language_id.PROBES)]
        for k in range(len(hits)):
            hits[k] += all((int(filters.masks[k // 64, at]) >> (k % 64)) & 1 for at in places)
        n += 1
    left = [max(0.0, (x - n * c) / (1 - c)) for x, c in zip(hits, filters.chance, strict=True)]
    if not n:
        return "und", 0.0
    return filters.languages[left.index(max(left))], max(left) / sum(left) if sum(left) else 0.0


def test_language_id_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    filters = language_id.learn(docs.where(language_id.remainder() != 0))
    docs = docs.where("length(text) < 3000").select("doc_id", "text", F.lit(7).alias("held_out"), F.lit("own").alias("lang_pred"))
    out = language_id.identify(docs, filters).collect()
    assert len(out) > 100 and all(r["held_out"] == 7 for r in out)
    for r in out:
        lang, score = plain_language(r["text"], filters)
        assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(score, abs=1e-9))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = language_id.learn(docs.where(language_id.remainder() != 0))
    out = language_id.identify(docs.where(language_id.remainder() == 0), filters)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def word_hash(word: str) -> int:
    return int(next(W.blocks(pa.array([word]), W.alnum_table())).hashes()[0])


def plain_score(text: str | None, known: lm_scoring.Vocabulary, net: lm_scoring.Network) -> float:
    """One document's score, word by word and node by node."""
    words, total = TOKEN.findall((text or "").translate(LOW)), 0.0
    place = {int(h): i for i, h in enumerate(known.words)}
    token = [place.get(word_hash(w), len(known.words) + word_hash(w) % len(known.log_size)) for w in words]
    t = net.tree
    for i, k in enumerate(token):
        h = sum(net.inputs[j][token[i + d] if 0 <= i + d < len(token) else known.size].astype(float) for j, d in enumerate(lm_scoring.PLACES))
        h = np.tanh(h)
        h[-1] = 1
        for first, node, side in ((t.near_first, t.near_node, t.near_side), (t.far_first, t.far_node, t.far_side)):
            for s in range(first[k], first[k + 1]):
                total -= math.log1p(math.exp(-side[s] * float(h @ net.outputs[node[s]])))
        total -= known.shares()[k]
    return total


def test_lm_scores(stored, rows, none):
    out = lm_scoring.fit_and_score(stored).collect()
    assert bag((r["doc_id"], r["n_tokens"]) for r in out) == bag((r[0], len(TOKEN.findall((r[1] or "").translate(LOW)))) for r in rows)
    assert all((r["log_likelihood"] < 0) == (r["n_tokens"] > 0) and (r["mean_log_likelihood"] is None) == (r["n_tokens"] == 0) for r in out)
    known = lm_scoring.vocabulary(stored)
    encoded = lm_scoring.encoded(stored, known)
    net = lm_scoring.train(encoded, known)
    texts = {r[0]: r[1] for r in rows if r[0] not in (3, 7)}
    scores = {r["doc_id"]: r["log_likelihood"] for r in lm_scoring.score(encoded, known, net).collect()}
    for doc in [*list(texts)[:24], *list(texts)[-6:]]:
        assert scores[doc] == pytest.approx(plain_score(texts[doc], known, net), rel=1e-4, abs=1e-4)
    assert lm_scoring.fit_and_score(none).count() == 0
    again = {(r["doc_id"], r["n_tokens"]): r["log_likelihood"] for r in lm_scoring.fit_and_score(stored.repartition(9, "n_chars")).collect()}
    assert all(again[r["doc_id"], r["n_tokens"]] == pytest.approx(r["log_likelihood"], rel=1e-3) for r in out)  # other files, same model


def test_network_probabilities_and_gradients(monkeypatch):
    monkeypatch.setattr(lm_scoring, "NEAR", 20)
    draw = np.random.default_rng(1)
    tree = lm_scoring.Tree.build(draw.integers(0, 1000, 150))
    net = lm_scoring.Network(tree)
    places = len(lm_scoring.PLACES)
    each = net.log_probability(np.arange(150), np.repeat(draw.integers(0, 151, (places, 1)), 150, axis=1))
    assert np.exp(each).sum() == pytest.approx(1, abs=1e-4)
    token, around = draw.integers(0, 150, 50), draw.integers(0, 151, (places, 50))
    whole = {k: np.zeros_like(v) for k, v in net.squares().items()}
    for name, at, g in net.sparse(token, around):
        whole[name][at] += g
    far, near = int(tree.far_node[0]), len(net.outputs) - 1
    for name, at in (("outputs", (far, 3)), ("outputs", (near, 15)), ("inputs", (1, int(around[1][2]), 5))):
        up, down = (lm_scoring.Network(tree, net.inputs, net.outputs) for _ in range(2))
        getattr(up, name)[at] += 1e-2
        getattr(down, name)[at] -= 1e-2
        slope = -(up.log_probability(token, around).sum() - down.log_probability(token, around).sum()) / 2e-2
        assert whole[name][at] == pytest.approx(slope, abs=2e-2)
    assert not whole["inputs"][..., -1].any()  # the unit that is always 1


def test_text_beats_its_words_in_disorder_and_noise(spark):
    """Text in which a word depends on the one before: held-out documents, the same shuffled, and random letters."""
    draw = random.Random(8)
    follow = {i: [draw.randrange(120) for _ in range(3)] for i in range(120)}

    def text(n: int) -> list[str]:
        at, out = draw.randrange(120), []
        for _ in range(n):
            out.append(f"w{at}")
            at = draw.choice(follow[at])
        return out

    docs = [(i, " ".join(text(150))) for i in range(1100)]
    asked = [text(150) for _ in range(100)]
    rows = [(3 * i, " ".join(t)) for i, t in enumerate(asked)] + [(3 * i + 1, " ".join(draw.sample(t, len(t)))) for i, t in enumerate(asked)]
    rows += [(3 * i + 2, " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(150))) for i in range(100)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    known = lm_scoring.vocabulary(docs)
    net = lm_scoring.train(lm_scoring.encoded(docs, known), known)
    asked = spark.createDataFrame(rows, "doc_id long, text string")
    mean = {r["doc_id"]: r["mean_log_likelihood"] for r in lm_scoring.score(lm_scoring.encoded(asked, known), known, net).collect()}
    assert sum(mean[3 * i] > mean[3 * i + 1] for i in range(100)) >= 95
    assert sum(mean[3 * i] > mean[3 * i + 2] for i in range(100)) >= 99


def test_vocabulary_follows_the_corpus(spark):
    draw = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in draw.zipf(1.2, 2000) % 30_000)) for i in range(60)], "doc_id long, text string")
    small, large = lm_scoring.vocabulary(docs.where("doc_id < 15")), lm_scoring.vocabulary(docs)
    words = Counter(w for r in docs.collect() for w in r["text"].split())
    assert 1.5 * len(small.words) < len(large.words) and len(large.words) == pytest.approx(2 * math.sqrt(120_000), rel=0.1)
    assert large.counts.sum() == 120_000 and len(large.words) + np.exp(large.log_size)[large.counts[len(large.words) :] > 0].sum() == pytest.approx(len(words))
    net = lm_scoring.Network(lm_scoring.Tree.build(large.counts))
    each = net.log_probability(np.arange(large.size), np.full((len(lm_scoring.PLACES), large.size), large.size))
    assert np.exp(each).sum() == pytest.approx(1, abs=1e-4)


def test_training_masks_every_token_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i"), (3, None), (4, "")], "doc_id long, text string").coalesce(1)
    known = lm_scoring.vocabulary(docs)
    net = lm_scoring.Network(lm_scoring.Tree.build(known.counts))
    seen = []
    monkeypatch.setattr(lm_scoring.Network, "learn", lambda self, token, around, squares: seen.extend(token.tolist()))

    class Sent:
        value = (net.tree.arrays(), net.inputs, net.outputs)

    rows = lm_scoring.encoded(docs, known).withColumn("part", F.lit(0)).toArrow().to_batches()
    for turn in range(lm_scoring.ROUNDS):
        list(lm_scoring._train(Sent, turn, 4)(rows))
    assert len(known.words) == 9 and sorted(seen) == list(range(9))


PAGES = {
    "<p>One, two &amp; three.</p><script>var t='</p>'</script>": "One, two & three.",
    "<body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>T</h1><p><b>Bold.<br><p>Second\n para.</article><footer>(c)</footer>": "T\nBold.\nSecond para.",
    "<div class='sidebar'><p>No, no, no</p></div><div id=main><p>Yes, it is the text.</p><p>More of it.</p><div class=comments><p>I, too, think so, indeed, yes</p></div></div>": "Yes, it is the text.\nMore of it.",
    "<!-- <p>hidden</p> --><p>a&nbsp;b &#65;&lt;</p>": "a b A<",
    "": "",
    "plain text": "plain text",
    "<div class=comment><p>All there is.</p></div>": "All there is.",
    "<table><tr><td>x, y<td>z</table>": "x, y\nz",
    "<article><p>open": "open",
    "<form><p>Name, please</p></form><p>Kept.</p><div class='cookie-notice'>We use, cookies, many, many</div>": "Kept.",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_extraction.main_text(page) == PAGES[page]


WHOLE = {
    "<html><head><title>T</title><meta charset=utf-8><body><p>One, two, three.</p></body></html>": "One, two, three.",
    "<head><title>T</title><link rel=x><p>No body tag, either.</p>": "No body tag, either.",
    "<head><title>T</title>Bare text.": "Bare text.",
    "<head><style>p {}</style></head><body><p>Closed head.</p>": "Closed head.",
    "<body><form id=aspnetForm role=form><div><p>All the text, in a form.</p><p>And more, of it.</p></div></form></body>": "All the text, in a form.\nAnd more, of it.",
    "<form role=search><p>Seek, find</p></form>": "",
    "<div class=comment><p>All, there, is, in, a, comment.</p></div><form><p>Name</p></form>": "All, there, is, in, a, comment.",
}


SCORED = {
    "<div class='notice-board-story'><p>All, of the, story.</p><p>More, of it.</p></div><div class=notice><p>Cookies.</p></div>": "All, of the, story.\nMore, of it.",
    "<div><div class='post-header'><h1>Title</h1></div><div class=post-body><p>Text, that is long, and has commas.</p><p>More.</p></div></div>": "Title\nText, that is long, and has commas.\nMore.",
    "<div class='site-header'><h1>Site</h1></div><div><p>Text, that is long, and has commas.</p><p>More.</p></div>": "Text, that is long, and has commas.\nMore.",
    "<main><article><p>One, two, three, four.</p></article><article><p>Five, six, seven.</p></article></main>": "One, two, three, four.\nFive, six, seven.",
    "<p>See &<b>amp;</b> x &amp;lt;</p>": "See &amp; x &lt;",
    "<div><div id=a><p>First, with commas, and words, and more.</p><p>Second, as long, as that.</p></div><div id=b><p>A sibling, with, enough, points.</p></div><div id=c><a href=x>link, link, link, link</a></div></div>":
        "First, with commas, and words, and more.\nSecond, as long, as that.\nA sibling, with, enough, points.",
    "<div><p>Short.</p><div class=comments>" + "<p>A long comment, with, many, commas, in it.</p>" * 9 + "</div></div>": "Short.",
}


@pytest.mark.parametrize("page", SCORED)
def test_pages_by_points(page):
    assert html_extraction.main_text(page) == SCORED[page]


@pytest.mark.parametrize("page", WHOLE)
def test_pages_with_open_heads_and_forms(page):
    assert html_extraction.main_text(page) == WHOLE[page]


def test_pages(spark):
    rows = [(1, "u", "<p>a, b</p>", 1), (None, None, None, 2), (1, "u", "<p>a, b</p>", 3), (4, "v", "<div>" * 20_000 + "deep" + "</i>" * 20_000, 4), (5, "w", "<p>" + "long, " * 50_000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = sorted((r["page_id"] or 0, r["text"]) for r in html_extraction.extract(pages).collect())
    assert out == [(0, ""), (1, "a, b"), (1, "a, b"), (4, "deep"), (5, ("long, " * 50_000).strip())]
    assert html_extraction.extract(pages.where("false")).count() == 0
