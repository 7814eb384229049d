"""The pipeline against plain versions of its stages, over a small corpus."""

import hashlib
import random
import re
from collections import defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from trailspark.llm import bpe


def shingles(text):
    words = text.encode().lower().split()
    n = min(5, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = {"aa": [a + b for a in ("ba", "da", "ga", "la") for b in ("bo", "do", "go", "lo")], "bb": [a + b for a in ("xi", "zi", "qi", "ky") for b in ("xy", "zy", "qy", "ku")]}
    say = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    docs = [(i, say(k, rng.randint(20, 60)), k) for i in range(120) for k in [rng.choice(["aa", "bb"])]]
    item = say("aa", 14)
    docs += [(200 + i, f"{docs[i][1]} {say(docs[i][2], 1)}", docs[i][2]) for i in range(20)] + [(300, docs[0][1], "aa"), (300, docs[0][1], "aa")]
    docs += [(400, f"{say('aa', 30)} {item} {say('aa', 10)}", "aa"), (401, f'{say("bb", 30)} token = "{"0a" * 20}" {say("bb", 9)}', "bb"), (402, "12 34 !!", "aa"), (403, None, None), (404, "", "aa")]
    folder = tmp_path_factory.mktemp("sf")
    rows = [(d, t, k, "src", len(t or "")) for d, t, k in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, item, str(folder)


def test_pipeline(spark, corpus):
    import tiktoken

    docs, item, folder = corpus
    kept = [(d, t) for d, t, _ in docs if t and re.search("[a-z]", t)]
    links = defaultdict(set)
    for i, (_, a) in enumerate(kept):
        for j, (_, b) in enumerate(kept[:i]):
            x, y = shingles(a), shingles(b)
            if 100 * len(x & y) >= 80 * len(x | y):
                links[i].add(j)
                links[j].add(i)
    alone, seen = [], set()
    for i in sorted(range(len(kept)), key=lambda i: kept[i][0]):
        if i not in seen:
            alone.append(kept[i])
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += links[k]
    clean = [(d, t) for d, t in alone if item not in t]
    safe = [(d, re.sub('token = "[0-9a-f]{40}', "<secret>", t)) for d, t in clean]
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}, special_tokens={})
    expected = sorted((d, len(coder.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in safe)
    found = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in found.collect()) == expected


def test_stages_keep_the_columns(spark, corpus):
    _, _, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_language_id_drops_foreign_texts(spark, corpus):
    docs, _, folder = corpus
    rng = random.Random(5)
    foreign = ["".join(rng.choice(letters) for _ in range(200)) for letters in ("абвгд ежзик", "天地玄黃宇宙洪荒", "mnrtw euhps", "MNRTW euhps 12 34", "mnrt9 w7uhps")]
    rows = [(500 + i, t, None, "src", len(t)) for i, t in enumerate(foreign)]
    table = spark.read.parquet(f"{folder}/documents.parquet")
    found = corpus_pipeline.language_id(spark, table.union(spark.createDataFrame(rows, table.schema)), folder)
    assert sorted(r.doc_id for r in found.collect()) == sorted(d for d, t, _ in docs if t and re.search("[a-z]", t))
