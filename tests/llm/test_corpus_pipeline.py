"""The pipeline's stages, each on what the one before left."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from graphloom.llm import jaccardjoin, langid, tokens


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_their_columns(spark, odd, sf):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_no_rows(spark, none, sf, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, none, sf).count() == 0


def test_near_copies(spark, odd, odd_rows, sf):
    out = corpus_pipeline.near_copy_stage(spark, odd, sf)
    left = [r for r in out.collect()]
    groups = jaccardjoin.joined(out).where("n_shingles > 0 AND n_links > 0")
    assert groups.count() == 0
    ids = Counter(r["doc_id"] for r in left)
    assert ids[100] == 2 and ids[101] == 0 and ids[102] == 0  # copies and near copies of 100; another text has its id, too
    texts = Counter(r[1] for r in odd_rows)
    assert sum(1 for r in left if not (r["text"] or "").strip()) == sum(n for t, n in texts.items() if not (t or "").strip())


def test_mixing_and_rejection(spark, odd, sf):
    assert rows(corpus_pipeline.mixing_stage(spark, odd, sf)) == rows(odd)
    kept = corpus_pipeline.language_stage(spark, odd, sf)
    assert kept.where("text IS NULL OR text = ''").count() == 0


def brute_lines(rows):
    """rows (doc_id, text) without lines that five documents hold, but in the largest doc_id."""
    held = defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    for i, text in rows:
        for line in text.split("\n"):
            held[key(line)].add(i)
    often = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    return [(i, "\n".join(x for x in text.split("\n") if often.get(key(x), i) == i)) for i, text in rows]


def brute_groups(rows, k=5, percent=80):
    """The least doc_id of each group of texts that links of k-word shingles join; texts without words are left."""
    sets = []
    for _, text in rows:
        w = re.split("[ \t\n\v\f\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, t) for i, (d, t) in enumerate(rows) if not sets[i] or least[root(i)] == d]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents in three languages with strange ones, repeated lines, copies and near copies."""
    rng = random.Random(21)
    parts = {"en": ["the", "and", "ing", "tion", "er"], "fr": ["eau", "ment", "la", "oi", "é"], "de": ["sch", "ung", "ein", "ü", "keit"]}
    line = "This notice stands at the foot of many of the documents"
    out = []
    for i in range(150):
        lang = ("en", "fr", "de")[i % 3]
        words = ["".join(rng.choices(parts[lang], k=2)) for _ in range(rng.randrange(20, 160))]
        text = "\n".join(" ".join(words[j : j + 25]) for j in range(0, len(words), 25))
        out.append((i, text + ("\n" + line if i % 5 == 0 else ""), lang, f"s{i % 4}"))
    for i in range(40):
        w = out[i * 3][1].split(" ")
        if i % 2:
            w[rng.randrange(len(w))] = "theer"
        out.append((200 + i, " ".join(w), out[i * 3][2], "s0"))
    out += [(300, "qxz zxq jkx vvw qqk " * 60, None, "s1"), (301, None, "en", "s1"), (302, "", "fr", None), (303, "12 34 !!", None, "s2")]
    path = tmp_path_factory.mktemp("corpus")
    rows_ = [(i, t, lang, source, len(t or "")) for i, t, lang, source in out]
    spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), out


def test_run(spark, corpus):
    """Every stage's documents by brute force, and the packed ids of those that are left, in the order of the mixture."""
    path, docs = corpus
    model = langid.learned(spark.read.parquet(f"{path}/documents.parquet"))
    _, _, rejected, _ = model.decide(pa.array([t for _, t, _, _ in docs], pa.large_string()))
    left = [(i, t) for (i, t, _, _), no in zip(docs, rejected, strict=True) if not no]
    assert {300, 301, 302, 303} == {d[0] for d in docs} - {i for i, _ in left}
    lines = brute_lines(left)
    assert sum(a != b for a, b in zip(left, lines, strict=True)) >= 20
    want = dict(brute_groups(lines))
    assert len(left) - len(want) >= 30

    stage = spark.read.parquet(f"{path}/documents.parquet")
    kept = stage
    for name, step in corpus_pipeline.STAGES[:4]:
        kept = step(spark, kept, path)
        if name == "language_id":
            assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(left)
        if name == "line_dedup":
            assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()) == Counter((i, t, len(t)) for i, t in lines)
        if name in ("near_copies", "mixing"):
            assert {r["doc_id"]: r["text"] for r in kept.collect()} == want

    ids_of = tokens.encoder(tokens.default_path())
    by_doc, sequences = defaultdict(list), Counter()
    for r in corpus_pipeline.run(spark, path).collect():
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]] += r["length"]
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        ids, at = np.append(ids_of(want[d]), 1).astype("<u4"), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) == pieces[0]["doc_tokens"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())
