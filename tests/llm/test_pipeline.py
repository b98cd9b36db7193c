"""The five stages on a small table, each against a brute-force version of itself."""

import re
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from posegrid.llm import line_rules, queries, simhash
from posegrid.llm.shared import settle

from .test_operators import SF, brute_components, brute_hits, brute_spans, encoder

#: Names that the operators use for themselves.
CLASHING = ("n_words", "kept", "_text", "clean_text", "_spans", "bits", "component_id", "contaminated", "start", "_held", "h")


def brute_line_fails(line):
    bare = line.strip(" ")
    n = bare.count(" ") + 1
    marked = len(re.findall("[#*$%&<>]", line)) + 2 * len(re.findall("!!", line))
    bars = len(re.findall("[|›»•·→]", line))
    return bool(
        (marked * 100 > n * 20 and marked >= 3)
        or (n <= 3 and not re.search(line_rules.END_MARK, line))
        or (bars >= 3 and bars * 100 >= n * 20)
        or (n <= 6 and re.search(line_rules.MENU, line, re.A))
        or (n <= 40 and re.search(line_rules.NOTICE, line, re.A))
    )


def brute_clean(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    if len(words) < 50 or 100 * len(covered) > 50 * len(words):
        return None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    good = [x for x in lines if not brute_line_fails(x)]
    lost = len(words) - sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in good)
    return "\n".join(good) if 100 * lost <= 30 * len(words) else None


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(one, other):
    return len(one & other) >= 0.8 * len(one | other)


def test_similar_documents(spark):
    """Near copies at every similarity, exact copies, short and empty texts, against all pairs."""
    import random

    rng = random.Random(8)
    texts = [None, "", " ", "one two", "One  two", "one two three", "a b c d e f"]
    for g in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((60, 200, 700)))]
        for _ in range(5):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randrange(0, max(2, len(words) // 40))):
                words[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        texts.append(texts[-1].upper())
    ids = [i if i % 7 else None for i in range(len(texts))]
    frame = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(zip(ids, texts))], "doc_id long, text string, node string, bits int").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect() if r.doc_id is not None}
    sets = {n: brute_shingles(t) for n, t in enumerate(texts)}
    roots = brute_components(sets, [(a, b) for a, b in combinations(sets, 2) if similar(sets[a], sets[b])])
    groups = {}
    for n, root in roots.items():
        groups.setdefault(root, []).append(ids[n])
    want = {i: min(x for x in groups[roots[n]] if x is not None) for n, i in enumerate(ids) if i is not None}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want) and all(want[got[i]] == want[i] for i in want)
    assert len(set(want.values())) < len(want) / 2
    assert simhash.similar_documents(frame.limit(0)).count() == 0


def test_no_link_is_lost_in_a_large_bucket(spark):
    """300 pairs of similar texts, all 600 alike enough to share large buckets, but only the pairs are linked."""
    import random

    rng = random.Random(3)

    def edited(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"x{rng.randrange(10**9)}"
        return words

    base = [f"w{i}" for i in range(300)]
    firsts = [edited(base, 7) for _ in range(300)]
    texts = [" ".join(w) for first in firsts for w in (first, edited(first, 5))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()}
    sets = {n: brute_shingles(t) for n, t in enumerate(texts)}
    want = brute_components(sets, [(a, b) for a, b in combinations(sets, 2) if similar(sets[a], sets[b])])
    assert len(set(want.values())) > 250 and got == want


def test_similar_documents_of_the_table(spark):
    """Of the pairs of different texts with a similarity of 0.8 in 10 000 documents, found by an exact prefix filter, 0.97 are in one group."""
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    sets = {r.doc_id: frozenset(map(hash, brute_shingles(r.text))) for r in docs.collect()}
    known = Counter(x for v in sets.values() for x in v)
    seen, pairs = {}, []
    for k in sorted(sets, key=lambda k: len(sets[k])):
        rare = sorted(sets[k], key=lambda x: (known[x], x))[: len(sets[k]) - int(-(-0.8 * len(sets[k]) // 1)) + 1]
        met = {c for x in rare for c in seen.get(x, ())}
        pairs += [(c, k) for c in met if sets[c] != sets[k] and similar(sets[c], sets[k])]
        for x in rare:
            seen.setdefault(x, []).append(k)
    assert len(pairs) > 200 and sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    equal = {}
    for k, v in sets.items():
        equal.setdefault(v, set()).add(got[k])
    assert all(len(groups) == 1 for v, groups in equal.items() if v)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select(*docs.columns, *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal docs
        out = settle(stages[name](spark, docs, SF), "test")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
        rows = out.collect()
        assert all(r.n_chars == len(r.text) and [r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in rows)
        return {r.doc_id: r.text for r in rows}

    texts = {k: c for k, t in texts.items() if (c := brute_clean(t)) is not None}
    assert step("quality_rules") == texts

    sets = {k: brute_shingles(t) for k, t in texts.items()}
    roots = brute_components(sets, [(a, b) for a, b in combinations(sets, 2) if similar(sets[a], sets[b])])
    texts = {k: t for k, t in texts.items() if roots[k] == k}
    assert step("near_duplicates") == texts

    texts = {k: t for k, t in texts.items() if not brute_hits(t, bench)[1]}
    assert step("decontamination") == texts

    for k, t in texts.items():
        for start, _, end in reversed(merged(brute_spans(t))):
            t = t[:start] + "[SECRET]" + t[end:]
        texts[k] = t
    assert step("secret_scans") == texts

    want = encoder("byte_bpe_50k.json")
    got = stages["packing"](spark, docs, SF).collect()
    for r in got:
        ids = [*want(texts[r.doc_id]), 0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert {r.doc_id for r in got} == set(texts)


def merged(spans):
    out = []
    for start, kind, end in spans:
        if out and start < out[-1][2]:
            out[-1] = (out[-1][0], kind, max(end, out[-1][2]))
        else:
            out.append((start, kind, end))
    return out


def test_decisions_follow_rows(spark):
    """Null ids, repeated rows and different texts under one id."""
    leak = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    one, two, three = (" ".join(f"{w}{i * i}" for i in range(80)) for w in ("red", "blue", "green"))
    rows = [(None, one), (None, one), (5, two), (5, two), (None, two), (7, three), (7, leak), (None, leak)]
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, nth int").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, docs, SF)
    assert kept.dtypes == docs.dtypes
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, one), (5, two), (7, three), (7, leak)], key=str)
    clean = stages["decontamination"](spark, docs, SF)
    assert clean.dtypes == docs.dtypes
    assert sorted(r.nth for r in clean.collect()) == [0, 1, 2, 3, 4, 5]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_queries_are_registered():
    names = [n for n in queries.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
