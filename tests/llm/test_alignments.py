"""Centroid clustering, cross-tokenizer alignment and license scans against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import clusters, crosstokens, licenses

rng = random.Random(11)


def lloyd(rows, k, rounds, seed):
    """(vec_id, cluster, distance) by plain rounds in Python integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in x]) for i, x in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min(range(len(centroids)), key=lambda c: (far(x, centroids[c]), c))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, x in kept:
            groups[nearest(x)].append(x)
        centroids = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else centroids[j] for j, g in enumerate(groups)]
    return Counter((i, nearest(x), min(far(x, centroids[nearest(x)]), (1 << 63) - 1)) for i, x in kept), centroids


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, x int, block string"


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_clusters_are_those_of_plain_rounds(spark, scale):
    groups = [[rng.gauss(0, scale) for _ in range(4)] for _ in range(5)]
    rows = [(i, [g + rng.gauss(0, 0.1 * scale) for g in groups[i % 5]]) for i in range(300)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300, 340)] + [(7, [1.0, 2.0, 3.0, 4.5]), (7, [1.0, 2.0, 3.0, 4.5]), (None, [0.5] * 4)]
    odd = [(900, None), (901, [1.0] * 3), (902, [1.0, 2.0, 3.0, None]), (903, [1.0, 2.0, 3.0, float("nan")]), (904, [1.0, 2.0, 3.0, float("inf")]), (905, [])]
    df = spark.createDataFrame([(i, x, 0, "c", 1, "b") for i, x in rows + odd], VECTORS)
    want, centroids = lloyd(rows, 6, 5, 3)
    out = clusters.clustered(df, k=6, rounds=5, width=4).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in out) == want
    assert {r.centroid_sha256 for r in out} <= {hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids}
    assert all(r.inertia == min(sum(d * n for (_, _, d), n in want.items()), (1 << 63) - 1) for r in out)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64)], "vec_id long, embedding array<float>")
    assert sorted((r.cluster, r.distance, r.inertia) for r in clusters.clustered(df).collect()) == [(0, 0, 0), (1, 0, 0)]
    assert clusters.clustered(df.limit(0)).count() == 0
    assert {r.cluster for r in clusters.clustered(df.withColumn("embedding", F.array_repeat(F.lit(1e30).cast("float"), 64))).collect()} == {0}


def test_bounds_spare_comparisons(spark):
    """Where vectors lie in clear groups, later rounds compare a few of them only."""
    middle = [[rng.uniform(-50, 50) for _ in range(8)] for _ in range(6)]
    df = spark.createDataFrame([(i, [m + rng.gauss(0, 1) for m in middle[i % 6]]) for i in range(1200)], "vec_id long, embedding array<double>")
    run = clusters.Clustering(df, k=6, width=8)
    for _ in range(6):
        run.assign()
        run.average()
    run.drop()
    assert run.scanned[0] == 1200 and run.scanned[-1] < 400


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def walked(text, tk, sp, letter):
    """(n_a, n_b, n_groups, digest), links by id pair: by sets of ends."""
    if not text:
        return (0, 0, 0, ""), Counter()
    a, b = tk.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    bytes_a = [bytes(letter[c] for c in tk.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return (0, 0, 0, ""), Counter()
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    groups = [([], []) for _ in cuts]
    for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
        for i, g in zip(ids, np.searchsorted(cuts, ends), strict=True):
            groups[g][side].append(i)
    text = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
    return (len(a), len(b), len(cuts), hashlib.sha256(text.encode()).hexdigest()), Counter((i, j) for x, y in groups for i in x for j in y)


@pytest.mark.parametrize("head", [0, 200, 1 << 19])
def test_alignment(spark, sf, head):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [None, "", " ", "▁ a", " lead", "two  blanks   here ", "x" * 3000, "日本語テキスト🙂🙂 emoji", "a\x00b\r\n\t c", "<s> </s> <|endoftext|> <unk>", "é" * 50 + "🙂" * 300, "\n\n  \n x", "w " * 30_000, "QzX9" * 900]
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).select("doc_id", "text")
    df = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts + texts[:5])] + [(None, "null id")], docs.schema))
    for c in ("row", "pair", "keys", "links", "docs", "n_a"):
        df = df.withColumn(c, F.lit("other"))
    rows = df.collect()
    each = [walked(r.text, tk, sp, letters()) for r in rows]
    held = Counter(p for _, links in each for p in links)
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    want = Counter()
    for r, ((n_a, n_b, groups, digest), links) in zip(rows, each, strict=True):
        want[(r.doc_id, n_a, n_b, groups, sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), digest)] += 1
    out = crosstokens.alignments(df, head=head).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out) == want
    assert crosstokens.alignments(df.limit(0)).count() == 0


def test_lanes_and_crossed_groups(monkeypatch):
    """Lanes of long documents give what one lane gives; large groups count by distinct ids."""
    both = crosstokens.tokenizers("byte_bpe_50k.json", "piece_bpe_32k.model")
    texts = ["".join(rng.choice("abcXYZ019+/é字 ") for _ in range(5000)), "🙂é字" * 400, "word " * 4000]
    want = crosstokens.aligned(texts, *both)
    monkeypatch.setattr(crosstokens, "LANE", 16)
    monkeypatch.setattr(crosstokens, "LINKS_AT_ONCE", 2)
    got = crosstokens.aligned(texts, *both)
    for k, v in want.items():
        assert np.array_equal(got[k], v), k


PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


@pytest.mark.parametrize("sent", [0, licenses.SENT])
def test_licenses(spark, sf, sent):
    mit = next(t.text for t in licenses.TEMPLATES if t.text.startswith("Permission is"))
    edited = mit.split()
    edited[5:5] = ["hereby", "kindly"]
    del edited[15]
    edited[20] = "code"
    texts = [
        None, "", "MIT", "mit license", "MIT-License, mit license; the MIT\nLICENSE", "mit  licenses amit license", "general public general public license", "mit license " * 3000, "GNU General Public\x00License É" * 3,
        "x " * 100 + mit + " y" * 50, "word " * 30 + " ".join(edited) + " word" * 30, " ".join(mit.split()[:8]), "w " * 30_000 + "apache license", "日本 mit license é", " ".join(w for p in zip(mit.split(), ["q"] * 99, strict=False) for w in p),
    ]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    df = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)] + [(-4, texts[3]), (-4, "other"), (None, texts[3]), (None, None)], docs.schema))
    for c in ("row", "template", "diagonal", "digest", "run", "found", "spans", "own_id", "labels"):
        df = df.withColumn(c, F.lit("other"))
    out = licenses.scanned(df, sent=sent).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == Counter((r.doc_id, *phrases(r.text)) for r in df.collect())
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in out}
    assert by[-10].labels == by[-11].labels == "mit" and by[-10].score == 1 and 0.8 <= by[-11].score < 1
    (span,) = by[-10].spans
    assert (span.first, span.last) == (100, 100 + len(mit.replace("-", " ").split()) - 1)
    assert by[-12].labels == by[-15].labels == "" and by[-12].score == by[-15].score == 0
    assert licenses.scanned(df.limit(0)).count() == 0
