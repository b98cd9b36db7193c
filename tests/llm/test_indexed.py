"""Structure repair, exact top-k search and the Merkle manifest against brute force, with odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.llm import merkle, pivot_index, queries, repair

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def brute_repair(turns):
    """Counts, the least (cost, audit) by a search of all edits, and the digest of the turns left."""
    turns = sorted(turns, key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    seen, faults = set(), ""
    for _, role, text in turns:
        bare = re.sub("[\x20\x09-\x0d]", "", text)
        faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, left = heapq.heappop(queue)
        if i == len(turns) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        own = [w for w in ("user", "assistant") if w[0] in NEXT[state]]
        options = [(2, "I", i, w[0], f"{w}:") for w in own]
        if i < len(turns):
            _, role, text = turns[i]
            options.append((3, "D", i + 1, state, None))
            if faults[i] not in "bd":
                more = faults[i] == "t"
                options += [(2 + more, "R", i + 1, w[0], f"{w}:{text}") for w in own]
                if role[:1] in NEXT[state]:
                    options.append((more, "K", i + 1, role[0], f"{role}:{text}"))
        for c, letter, at, then, line in options:
            heapq.heappush(queue, (cost + c, audit + letter, at, then, left + ((line,) if line is not None else ())))
    digest = hashlib.sha256("\n".join(left).encode()).hexdigest()
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest


def brute_damage(rows):
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: brute_repair(turns) for c, turns in found.items()}


def odd_turns():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "usher"]
    texts = ["Yes.", "No?", "So", "", " \t", None, "Yes. \n", "é!"]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(9)]), rng.choice(roles[: rng.choice([2, 7])]), rng.choice(texts)) for _ in range(500)]
    rows += [(70, t, "user", "Again and again") for t in range(3000)]
    rows += [(71, t, "assistant", f"{t}.") for t in range(2500)] + [(72, t, "ua"[t % 2], "x" * 200_000 + str(t)) for t in range(3)]
    return rows


def test_repair_equals_a_search_of_all_edits(spark):
    rows = odd_turns()
    turns = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, at int, conv string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(repair.damaged(turns)).collect()}
    want = brute_damage(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert repair.repair_report(repair.damaged(turns.limit(0))).count() == 0


def test_repair_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op11_structure_repair(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute_damage(rows)


def test_a_conversation_that_is_lost_whole_is_reported(spark):
    lost = next(c for c in range(10**4) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns = spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    row = repair.repair_report(repair.damaged(turns)).first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_long_runs_are_unrolled_as_short_ones():
    for symbol in (("u", 0), ("a", 3), ("s", 0), ("x", 0), ("", 1)):
        at_once, parts = repair.plan([(symbol, 4001)]), repair.plan([(symbol, 1)] * 4001)
        assert at_once == parts


def brute_top(rows, k):
    kept = [(i, key, np.floor(256 * np.array(v, float))) for i, (key, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wide = max((len(v) for *_, v in kept), default=0)
    found = []
    for i, key, v in kept:
        if key is None or key % 50:
            continue
        scores = []
        for j, other, w in kept:
            if i != j:
                n = min(len(v), len(w))
                product = sum(int(a) * int(b) for a, b in zip(v[:n], w[:n]))
                scores.append((-max(min(product, 2**63 - 1), -(2**63) + 1), other is None, other or 0))
        found += [(key, r + 1, None if gone else other, -score) for r, (score, gone, other) in enumerate(sorted(scores)[:k])]
    return sorted(found, key=str), wide


def odd_vectors():
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.1, 1, 5])).tolist()) for i in range(900)]
    rows += [(1000 + i, [0.5] * 12) for i in range(400)] + [(50, [1.0] * 12), (50, [1.0] * 12), (None, [3.0] * 12), (None, [9.0] * 12)]
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 12), (2150, [float("inf")]), (2200, []), (2250, [0.0] * 12), (2300, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize("scale", [1, 2**18, 2**40])
def test_top_k_equals_brute_force(spark, monkeypatch, scale):
    """Small annuli and slices, so that both rounds expand; number types of all three sizes."""
    for name, value in (("RING_ROWS", 16), ("RING_NUMBERS", 1), ("GROUP_ROWS", 8), ("GROUP_NUMBERS", 1), ("SLICE_RINGS", 3), ("PIVOTS", 9)):
        monkeypatch.setattr(pivot_index, name, value)
    rows = [(k, None if v is None else [None if x is None else x * scale for x in v]) for k, v in odd_vectors()]
    rows = rows if scale < 2**30 else rows[::7]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<double>, key int, ring string").repartition(3)
    got = sorted(map(tuple, pivot_index.search(frame, F.col("id") % 50 == 0, 5).collect()), key=str)
    assert got == brute_top(rows, 5)[0]
    assert pivot_index.search(frame.limit(0), F.col("id") % 50 == 0, 5).count() == 0
    assert pivot_index.search(frame, F.col("id") < 0, 5).count() == 0


def test_top_k_on_the_table(spark):
    rows = [tuple(r)[:2] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(map(tuple, queries.op12_top_vectors(spark, "/root/testdata/sf0.1").collect()), key=str)
    assert got == brute_top(rows, 5)[0]


def brute_manifest(rows, arity):
    """rows of (part, id, leaf, claim): for every row (id, leaf, subroot, root, proof, folded root)."""

    def sha(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha(levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            first = i // arity * arity
            yield level[first:i], level[i + 1 : first + arity]
            i //= arity

    parts = {}
    for row in rows:
        parts.setdefault(row[0], []).append(row)
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    for p in names:
        parts[p].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    trees = [tree([r[2] for r in parts[p]]) for p in names]
    over = tree([t[-1][0] for t in trees])
    found = []
    for t, p in enumerate(names):
        for i, (_, key, leaf, claim) in enumerate(parts[p]):
            steps = [*path(trees[t], i), *path(over, t)]
            top = claim
            for before, after in steps:
                top = sha([*before, top, *after])
            proof = "".join(x for before, after in steps for x in (*before, *after))
            found.append((key, leaf, trees[t][-1][0], over[-1][0], proof, top))
    return sorted(found, key=str)


@pytest.mark.parametrize(("arity", "run"), [(2, 4096), (2, 8), (3, 9), (5, 4)])
def test_manifest_equals_brute_force(spark, monkeypatch, arity, run):
    monkeypatch.setattr(merkle, "RUN_LEAVES", run)
    rng = random.Random(arity)
    rows = []
    for part, n in ((None, 1), ("", 7), ("a", 60), ("é", 33), ("z", 1), ("b", 2)):
        for _ in range(n):
            leaf = hashlib.sha256(str(rng.random()).encode()).hexdigest()
            rows.append((part, rng.choice([None, *range(40)]), leaf, leaf if rng.random() < 0.7 else leaf[::-1]))
    rows += rows[:5] * 3
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "part string, id long, leaf string, claim string, rank int, tree int").repartition(3)
    got = [(r.id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in merkle.manifest(frame, arity, with_proofs=True).collect()]
    want = brute_manifest(rows, arity)
    assert [x[:5] for x in sorted(got, key=str)] == [x[:5] for x in want]
    assert sorted((x[0] is None, x[0] or 0, x[1], x[5]) for x in got) == sorted((x[0] is None, x[0] or 0, x[1], x[5]) for x in want)
    assert merkle.manifest(frame.limit(0), arity).count() == 0


def test_manifest_of_odd_documents(spark, tmp_path):
    def told(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    docs = [(None, "a", "en", None, 5), (1, None, None, "s", None), (2, "", "", "", 0), (3, "é" * 10**6, "en", "s", 2**63 - 1), (3, "é" * 10**6, "en", "s", 2**63 - 1)]
    docs += [(i, f"text {i}", random.Random(i).choice(["de", None, "en"]), "web", i) for i in range(4, 60)]
    folder = str(tmp_path)
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, leaf string")
    frame.write.parquet(f"{folder}/documents.parquet")
    rows = []
    for key, text, lang, source, size in docs:
        leaf = hashlib.sha256("".join(map(told, (key, source, lang, size, text))).encode()).hexdigest()
        more = size is not None and key is not None and zlib.crc32(str(key).encode()) % 7 == 0
        claim = hashlib.sha256("".join(map(told, (key, source, lang, size + 1, text))).encode()).hexdigest() if more else leaf
        rows.append((lang, key, leaf, claim))
    want = [(*x[:4], hashlib.sha256(x[4].encode()).hexdigest(), x[5], x[3] == x[5]) for x in brute_manifest(rows, 2)]
    got = queries.op13_merkle_manifest(spark, folder)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r.verified for r in got.collect()} == {True, False}
