"""Quality voting, the prefix trie and lexical search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from trailspark.llm import lexical, prefixtrie, quality, registry

EXTRA = "row long, body string, score double, conv long, n long, depth long, doc long, number long, place int"


def frame(spark, rows, schema):
    """A table with columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "x", 0.5, 3, 4, 5, 6, 7, 8) for r in rows], f"{schema}, {EXTRA}")


# quality


def quality_corpus(count=240, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(count):
        some, good = [rng.choice(words) for _ in range(rng.randint(20, 120))], i % 4 != 0
        text = " ".join(some).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in some) if i % 8 else " ".join([some[0]] * 80)
        docs.append((i, text))
        if i % 5:
            labels.append((i, int(good)))
    docs += [(900, None), (901, ""), (902, "x"), (903, docs[1][1] * 200), (None, docs[1][1]), (904, docs[4][1]), (904, docs[4][1])]
    labels += [(7777, 1), (None, 0), (1, None), (2, 0), (2, 1), (900, 1)]
    return docs, labels


def test_quality(spark):
    docs, labels = quality_corpus()
    table, known = frame(spark, docs, "doc_id long, text string"), frame(spark, labels, "doc_id long, quality int")
    model = quality.fit(table, known.where("doc_id % 3 > 0"))
    found = quality.score(table, model, keep=("doc_id", "text", "row")).collect()
    assert Counter((r.doc_id, r.text, r.row) for r in found) == Counter((d, t, 1) for d, t in docs)
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add(r.score)
        assert 0 <= r.score <= 1
    assert all(len(s) == 1 for s in by.values())
    right = [(by[i].copy().pop() >= 0.7) == (i % 4 != 0) for i in range(240) if i % 3 == 0]
    assert sum(right) / len(right) > 0.97
    assert by[None] == by[1] and by[900] == by[901] == {model.share}


def test_quality_against_explicit_votes(spark):
    docs, labels = quality_corpus(120, 5)
    table, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(table, known)
    vectors = np.array([model.project(quality.terms(t)[None, :])[0] for _, t in docs])
    expected = []
    for v in vectors:
        near = sorted(range(len(model.labels)), key=lambda i: (-round(float(v @ model.vectors[i]), 9), i))[: quality.NEIGHBOURS]
        votes = [(max(0.0, float(v @ model.vectors[i])) * model.weights[i], model.labels[i]) for i in near]
        total = sum(w for w, _ in votes)
        expected.append(sum(w * y for w, y in votes) / total if total > 1e-9 else model.share)
    found = quality.score(table, model, keep=("doc_id", "text")).collect()
    told = {(d, t): e for (d, t), e in zip(docs, expected)}
    assert all(abs(r.score - told[r.doc_id, r.text]) < 1e-6 for r in found)


def test_quality_terms_count_by_hand():
    found = quality.terms("Aab  b1 Aab!!")
    shape = quality.shape("Aab  b1 Aab!!")
    assert "".join(map(chr, shape)) == "Aa a0 Aa!"
    n = len(shape)
    shapes, distances = found[: 1 << quality.SHAPE_BITS], found[1 << quality.SHAPE_BITS :][: quality.DISTANCES]
    assert shapes.sum() == sum(n - k for k in range(quality.SHAPE_MOST)) and distances.sum() == 3
    assert quality.terms("a b a a")[1 << quality.SHAPE_BITS :][:4].tolist() == [2, 1, 1, 0]


def test_quality_without_a_label(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(9, 0), (8, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        share = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
        assert {r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {share}
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0


# the prefix trie


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    turns = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in turns.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:]
    return turns, out


def brute_trie(convs):
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return Counter(out)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks(seed, convs=60, longest=12, texts=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, convs), 10**12, -(10**12) + 1]:
        if rng.random() < 0.15:
            continue
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 2 else "user", rng.choice(["a", "bé", "", "long text"][:texts])))
    rows += [(3, None, None, None), (3, None, "user", ""), (4, 2, "x", "tie"), (4, 2, "x", "tie"), (4, 2, "w", "tie"), (None, 0, "user", "lost"), (5, 9, None, "t"), (5, 9, "", "t")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_query(spark, tmp_path, seed):
    rows = talks(seed)
    frame(spark, rows, "conv_id long, turn long, role string, text string").withColumnRenamed("row", "own").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = prefixtrie.op12_prefixtrie(spark, str(tmp_path))
    assert found.columns == NAMES
    assert Counter(tuple(r) for r in found.collect()) == brute_trie(rebuilt(rows)[1])


@pytest.mark.parametrize("sizes", [{"segment_turns": 512, "range_turns": 40}, {"segment_turns": 3, "range_turns": 30, "piece_bytes": 4}, {"segment_turns": 1, "range_turns": 10**6}])
def test_trie_in_ranges_and_segments(spark, sizes):
    rows = talks(7, convs=90, texts=2) + [(1000 + i, t, "user", "same") for i in range(60) for t in range(7)]
    table = frame(spark, rows, "conv_id long, turn long, role string, text string")
    found = prefixtrie.conversation_trie(table, sizes=sizes).select(*NAMES).collect()
    assert Counter(tuple(r) for r in found) == brute_trie(rebuilt(rows)[0])


def test_trie_of_one_long_conversation_and_of_none(spark):
    rows = [(1, t, "user", f"t{t % 7}") for t in range(170)] + [(2, t, "user", f"t{t % 7}") for t in range(128)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = Counter(tuple(r) for r in prefixtrie.conversation_trie(table, sizes={"segment_turns": 64}).collect())
    assert found == brute_trie(rebuilt(rows)[0])
    assert prefixtrie.conversation_trie(table.limit(0)).collect() == []


def test_trie_handles_and_exit_nodes():
    """Each node stands under the handle of its length, and what is located is where the string leaves the trie."""
    rng = random.Random(4)

    def text(turns):
        one, two = [0], [0]
        for i, t in enumerate(turns):
            h = hashlib.md5(f"{i}:{t}".encode()).digest()
            one.append((one[-1] + int.from_bytes(h[:8], "big")) & prefixtrie._MASK)
            two.append((two[-1] + int.from_bytes(h[8:], "big")) & prefixtrie._MASK)
        found = prefixtrie.Text(one, two, [0] * len(one), 0, 1, 0, None, True, 0, None)
        return found

    strings = sorted({tuple(rng.choice("ab") if i < 6 or rng.random() < 0.02 else "a" for i in range(rng.randint(0, 40))) for _ in range(300)})
    trie, known = prefixtrie.ZFastTrie(), {}
    for start in range(0, len(strings), 37):
        batch = [text(s) for s in strings[start : start + 37]]
        trie.insert(batch)
        known |= dict(zip(batch, strings[start:]))
    prefixes = {s[:d] for s in strings for d in range(len(s) + 1)}
    nodes = {p for p in prefixes if not p or p in strings or len({q for q in (p + ("a",), p + ("b",)) if q in prefixes}) > 1}
    assert {known[trie.text[i]][: trie.extent[i]] if i else () for i in range(len(trie.extent))} == nodes
    assert len(trie.handles) == len(nodes) - 1
    for (length, *_), node in trie.handles.items():
        low, high = trie.extent[trie.parent[node]], trie.extent[node]
        assert low < length <= high and length == max(range(low + 1, high + 1), key=lambda x: x & -x)
    for s in [tuple(rng.choice("ab") for _ in range(rng.randint(0, 45))) for _ in range(200)] + strings:
        base, edge = trie.locate(text(s))
        deepest = max((p for p in nodes if s[: len(p)] == p), key=len)
        assert trie.extent[base] == len(deepest)
        assert (edge is not None) == (len(s) > len(deepest) and s[: len(deepest) + 1] in prefixes)


# lexical search


def brute_ranked(docs, queries, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: Counter(term.findall((t or "").translate(lower)))
    found = [(d, split(t)) for d, t in docs]
    total, length = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = Counter()
    for q, text in queries:
        scores = []
        for d, c in found:
            n = sum(c.values())
            s = sum(x * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * total // length))) for t, x in split(text).items() if c[t])
            if s > 0 and d is not None:
                scores.append((-s, d))
        for i, (s, d) in enumerate(sorted(scores)[:k]):
            out[q, i + 1, d, -s] += 1
    return out


def lexical_tables(seed=1, count=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["É", "ß1", "Foo", "BAR_baz", "x-y"]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([5, 50, 205])]) for _ in range(rng.randint(1, 60)))) for i in range(count)]
    docs += [(i + 500, docs[i][1]) for i in range(min(60, count))]  # ties
    docs += [(990, None), (991, ""), (992, " .,;"), (None, docs[0][1]), (3, docs[3][1]), (993, "w1 " * 50000), (994, "É É ß1 FOO bar baz")]
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(30)]
    queries += [(50, None), (51, ""), (52, "unknown words"), (None, "w1 w2"), (5, queries[5][1]), (53, "é"), (54, "É foo FOO x"), (55, docs[7][1])]
    return docs, queries


@pytest.mark.parametrize("options", [{}, {"shard_rows": 50, "common": 5}, {"most_pairs": 60}])
def test_lexical_search(spark, options):
    docs, queries = lexical_tables()
    found = lexical.ranked(frame(spark, docs, "doc_id long, text string").repartition(3), frame(spark, queries, "item_id long, text string"), 10, **options).collect()
    assert Counter(tuple(r) for r in found) == brute_ranked(docs, queries, 10)


def test_lexical_search_of_nothing(spark):
    docs, queries = lexical_tables(count=10)
    docs, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    assert lexical.ranked(docs.limit(0), queries, 10).collect() == []
    assert lexical.ranked(docs, queries.limit(0), 10).collect() == []
    assert lexical.ranked(docs.where("text is null"), queries, 10).collect() == []


def test_ball_tree_bounds_and_pruning():
    rng = np.random.default_rng(0)
    points = np.zeros((600, 40))
    for i in range(600):
        points[i, rng.choice(40, 6, replace=False)] = rng.integers(1, 10**9, 6) if i % 50 == 0 else rng.integers(1, 1000, 6)
    vectors = (rng.random((12, 40)) < 0.2) * rng.integers(1, 3, (12, 40)).astype(float)
    block = lexical.Block(np.arange(12), np.arange(40), vectors, np.zeros(12, np.int64), 5)
    tree = lexical.BallTree(points)
    bounds, scores = tree.bounds(block), (vectors @ points.T).astype(np.int64)
    for i, (lo, hi, left, right) in enumerate(tree.nodes.tolist()):
        assert (bounds[:, i] >= scores[:, tree.order[lo:hi]].max(1)).all()
        assert left < 0 or [*range(lo, hi)] == [*range(*tree.nodes[left][:2]), *range(*tree.nodes[right][:2])]
    opened = tree.search(points, np.arange(600), block, True)
    assert opened < 0.5 * 12 * (tree.nodes[:, 2] < 0).sum()
    for i in range(12):
        best = sorted((-s, d) for d, s in enumerate(scores[i].tolist()) if s > 0)[:5]
        assert [(-s, d) for s, d in zip(block.scores[i].tolist(), block.found[i].tolist()) if s] == best


@pytest.mark.parametrize("name", ["op12_prefixtrie", "op13_lexical"])
def test_new_queries_against_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    expected = con.sql(registry.oracle_sql()[name])
    found = registry.queries()[name](spark, sf_dir).select(*expected.columns)
    assert Counter(tuple(r) for r in found.collect()) == Counter(expected.fetchall())


def test_quality_query_on_the_smallest_tables(spark, sf_dir):
    found = registry.queries()["op11_quality"](spark, sf_dir).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in found} == docs and len(found) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in found)
